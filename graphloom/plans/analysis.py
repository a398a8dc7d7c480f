"""Registered queries: graph, history, metric, governance, visual and diagnostic operators over the fixture graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.taxonomy import ANCHOR_KINDS
from ..operators import clustering, diagnostics, governance, graph as G, history, linking, metrics, search, templates, visual
from ..sources import store
from .fixtures import graph, prefix

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
A, C, EV = ("an", "ae"), ("cn", "ce"), ("an", "ae", "co")
SYM = "user::25::error"

#: Snapshots of the activity graph as further table expressions.
W = """
, n1 AS MATERIALIZED (SELECT * FROM an WHERE snapshot_id = 'w1'), e1 AS MATERIALIZED (SELECT * FROM ae WHERE snapshot_id = 'w1')
, n2 AS MATERIALIZED (SELECT * FROM an WHERE snapshot_id = 'w2'), e2 AS MATERIALIZED (SELECT * FROM ae WHERE snapshot_id = 'w2')"""


def add(name, query, sql=None, needs=()):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"{prefix(*needs)}\n{sql}" if needs else sql


def week(spark, d, w="w2"):
    return history.at(graph(spark, d, "an"), w), history.at(graph(spark, d, "ae"), w)


def activity(f):
    return lambda spark, d: f(*week(spark, d))


def weeks(f):
    return lambda spark, d: f(*week(spark, d, "w1"), *week(spark, d, "w2"))


def containment(f):
    return lambda spark, d: f(graph(spark, d, "cn"), graph(spark, d, "ce"))


# Traversals ---------------------------------------------------------------------------------------------------------
def _walk(a: str, b: str, depth: int, types: str = "") -> str:
    return f"""{W}, walk AS (
  SELECT '{SYM}' AS id, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM walk w JOIN e2 e ON e.{a} = w.id WHERE w.depth < {depth} {types}
)"""


add("upstream_bfs", activity(lambda n, e: G.bfs(e, SYM, "upstream", 5)), _walk("target_id", "source_id", 5) + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id", A)
add("downstream_trace", activity(lambda n, e: G.bfs(e, SYM, "downstream", 10)), _walk("source_id", "target_id", 10) + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id", A)
add("ego_subgraph", activity(lambda n, e: e.join(G.bfs(e, SYM, "downstream", 8).select(F.col("id").alias("source_id")), "source_id", "left_semi").select("source_id", "target_id", "type")),
    _walk("source_id", "target_id", 8) + " SELECT source_id, target_id, type FROM e2 WHERE source_id IN (SELECT id FROM walk)", A)
add("neighbours_by_type", activity(lambda n, e: G.neighbours(e, SYM, "upstream", "CALLS").select("source_id", "target_id", "type", "weight")), f"{W} SELECT source_id, target_id, type, weight FROM e2 WHERE target_id = '{SYM}' AND type = 'CALLS'", A)
add("flow_trace_steps", activity(lambda n, e: G.flow(e, SYM).select("source_id", "target_id", "type")),
    _walk("source_id", "target_id", 9, "AND e.type IN ('CALLS', 'ACCESSES')") + " SELECT DISTINCT source_id, target_id, type FROM e2 WHERE type IN ('CALLS', 'ACCESSES') AND source_id IN (SELECT id FROM walk)", A)
add("process_closure", activity(lambda n, e: G.processes(n, e).select("root", "size", F.array_join("members", ",").alias("members"))), f"""{W}
, roots AS MATERIALIZED (SELECT id FROM n2 WHERE id NOT IN (SELECT target_id FROM e2 WHERE type = 'CALLS'))
, walk AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT w.root, e.target_id, w.depth + 1 FROM walk w JOIN e2 e ON e.source_id = w.id WHERE e.type IN ('CALLS', 'ACCESSES') AND w.depth < 10)
SELECT root, count(DISTINCT id) AS size, string_agg(DISTINCT id, ',' ORDER BY id) AS members FROM walk GROUP BY root""", A)
add("test_coverage", activity(lambda n, e: G.test_coverage(n, e).select("id", F.array_join("covered_by", ",").alias("covered_by"))), f"""{W}
, e3 AS MATERIALIZED (SELECT * FROM e2 WHERE target_id IN (SELECT id FROM n2))
, walk AS (SELECT id AS root, file, id, 0 AS depth FROM n2 WHERE is_test UNION SELECT w.root, w.file, e.target_id, w.depth + 1 FROM walk w JOIN e3 e ON e.source_id = w.id WHERE w.depth < 5)
SELECT w.id, string_agg(DISTINCT w.file, ',' ORDER BY w.file) AS covered_by FROM walk w JOIN n2 ON n2.id = w.id WHERE NOT n2.is_test GROUP BY w.id""", A)
_IMPACT = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in G.IMPACT_WEIGHTS.items()) + " ELSE 1.0e0 END"
_REACH = f"""{W}
, step AS MATERIALIZED (SELECT target_id AS a, source_id AS b, min({_IMPACT}) AS w FROM e2 GROUP BY 1, 2)
, walk AS (SELECT '{SYM}' AS id, 0.0e0 AS d UNION SELECT s.b, round(walk.d + s.w, 6) FROM walk JOIN step s ON s.a = walk.id WHERE walk.d + s.w <= 5)
, best AS (SELECT id, min(d) AS distance FROM walk WHERE id <> '{SYM}' GROUP BY id)"""
add("blast_radius_weighted", activity(lambda n, e: G.impact(e, SYM)), _REACH + " SELECT id, distance FROM best", A)
add("impact_score", activity(lambda n, e: G.impact_score(G.impact(e, SYM))), _REACH + """
, s AS (SELECT count(*) AS affected, floor(round(coalesce(sum(1 / distance), 0), 9) * 100 + 0.5) / 100 AS score FROM best)
SELECT affected, score, CASE WHEN score < 2 THEN 'LOW' WHEN score < 5 THEN 'MEDIUM' WHEN score < 15 THEN 'HIGH' ELSE 'CRITICAL' END AS risk FROM s""", A)
_PATH = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in G.PATH_WEIGHTS.items()) + " ELSE 1.0e0 END"
add("shortest_path", activity(lambda n, e: G.path(e, SYM, "user::25::view").select("weight", F.array_join("path", ">").alias("path"))), f"""{W}
, step AS MATERIALIZED (SELECT source_id AS a, target_id AS b, min({_PATH}) AS w FROM e2 WHERE source_id LIKE 'user::25::%' GROUP BY 1, 2)
, walk AS (SELECT '{SYM}' AS id, 0.0e0 AS d, ['{SYM}'] AS path UNION ALL SELECT s.b, walk.d + s.w, list_append(walk.path, s.b) FROM walk JOIN step s ON s.a = walk.id WHERE NOT list_contains(walk.path, s.b))
SELECT round(d, 6) AS weight, array_to_string(path, '>') AS path FROM walk WHERE id = 'user::25::view' ORDER BY d, path LIMIT 1""", A)

# Ranking and components ---------------------------------------------------------------------------------------------
add("pagerank", activity(lambda n, e: G.pagerank(n, e).select("id", F.round("rank", 9).alias("rank"), F.round("energy", 6).alias("energy"))), f"""{W}
, v AS MATERIALIZED (SELECT id FROM n2 WHERE canonical_kind IN {ANCHOR_KINDS!r})
, k AS MATERIALIZED (SELECT count(*) AS n FROM v)
, m AS MATERIALIZED (SELECT source_id, target_id, count(*) AS m FROM e2 WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v) GROUP BY 1, 2)
, moves AS MATERIALIZED (SELECT source_id, target_id, m / sum(m) OVER (PARTITION BY source_id) AS p FROM m)
, pr AS (
  SELECT 0 AS it, id, 1.0e0 / n AS r FROM v, k
  UNION ALL
  SELECT c.it + 1, c.id, 0.15e0 / n + 0.85e0 * (coalesce(g.got, 0) + coalesce(l.lost, 0) / n)
  FROM pr c CROSS JOIN k
  LEFT JOIN (SELECT mv.target_id AS id, sum(pr.r * mv.p) AS got FROM pr JOIN moves mv ON mv.source_id = pr.id GROUP BY 1) g ON g.id = c.id
  CROSS JOIN (SELECT sum(r) AS lost FROM pr WHERE id NOT IN (SELECT source_id FROM moves)) l
  WHERE c.it < 30
)
SELECT n2.id, round(coalesce(r, 0), 9) AS rank, round(coalesce(r, 0) * n, 6) AS energy FROM n2 CROSS JOIN k LEFT JOIN pr ON pr.id = n2.id AND pr.it = 30""", A)
_DEG = "deg AS MATERIALIZED (SELECT id, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM %s UNION ALL SELECT target_id, 1, 0 FROM %s) GROUP BY id)"
add("energy", activity(lambda n, e: G.energy(e)), f"{W}, {_DEG % ('e2', 'e2')} SELECT id, 2 * i + o AS energy, round(log10(2 * i + o + 1) / 10, 6) AS rank FROM deg", A)
add("degrees", activity(lambda n, e: G.degrees(e)), f"{W}, {_DEG % ('e2', 'e2')} SELECT id, i AS in_degree, o AS out_degree, i + o AS degree FROM deg", A)
add("degree_stats", activity(G.stats), f"""{W}, d AS (SELECT count(*) AS d FROM e2 GROUP BY source_id)
SELECT (SELECT count(*) FROM n2) AS node_count, (SELECT count(*) FROM e2) AS edge_count, (SELECT list_sort(list(d))[CAST(floor(count(*) / 2) AS BIGINT) + 1] FROM d) AS median_degree,
  round((SELECT count(*) FROM e2) / (SELECT count(*) FROM n2), 6) AS density""", A)
add("entry_point_detection", containment(lambda n, e: G.entry_points(n, e).groupBy("canonical_kind", "is_entry_point").agg(F.count(F.lit(1)).alias("n"))), f"""
, {_DEG % ('ce', 'ce')}
SELECT canonical_kind, (coalesce(i, 0) = 0 AND coalesce(o, 0) > 0 AND semantic_kind IN ('module', 'file', 'function', 'class')) OR lower(name) IN ('main', 'app', 'run', 'start', 'cli', 'index', 'handler', 'server', 'cmd', 'entry') OR is_entry_point AS is_entry_point, count(*) AS n
FROM cn LEFT JOIN deg USING (id) GROUP BY 1, 2""", C)
_SCC = f"""{W}
, reach AS (SELECT source_id AS a, target_id AS b FROM e2 UNION SELECT r.a, e.target_id FROM reach r JOIN e2 e ON e.source_id = r.b)
, mutual AS MATERIALIZED (SELECT x.a AS id, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
, scc AS MATERIALIZED (SELECT id, max(other) AS component, count(*) AS size FROM mutual GROUP BY id)"""
add("scc", activity(lambda n, e: G.strong_components(e)), _SCC + " SELECT id, component, size FROM scc", A)
add("cycles", activity(lambda n, e: templates.cycles(governance.mark_cycles(n.withColumn("file", F.col("id")), e), e, "w2")),
    _SCC + " SELECT n2.id, n2.name, n2.id AS file, risk, namespace_id, 'cycle' AS anomaly FROM n2 JOIN scc USING (id) WHERE size > 1 ORDER BY risk DESC, id LIMIT 10", A)
add("weak_components", activity(lambda n, e: G.components(e)))
ORACLES["weak_components"] = f"""{prefix(*A)}{W}
, ways AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM e2 UNION SELECT target_id, source_id FROM e2)
, reach AS (SELECT a, b FROM ways UNION SELECT r.a, x.b FROM reach r JOIN ways x ON x.a = r.b)
SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a"""
add("topological_levels", containment(lambda n, e: G.topological_levels(e.where("type = 'MEMBER_OF'"))), """
, lv AS (SELECT 'ecosystem::global' AS id, 0 AS level UNION ALL SELECT e.source_id, lv.level + 1 FROM lv JOIN ce e ON e.target_id = lv.id AND e.type = 'MEMBER_OF')
SELECT DISTINCT id, CAST(level AS INTEGER) AS level FROM lv""", C)

# Visual -------------------------------------------------------------------------------------------------------------
_UP = """
, up AS (SELECT id, id AS pos, parent_id AS nxt, 0 AS hops, {ok} AS ok FROM cn UNION ALL SELECT u.id, c.id, c.parent_id, u.hops + 1, {okc} FROM up u JOIN cn c ON c.id = u.nxt WHERE NOT u.ok AND u.hops < 20)
, nvp AS MATERIALIZED (SELECT id, pos AS ancestor, hops FROM up WHERE ok)"""
_NVP = _UP.format(ok="canonical_rank IN (0, 1, 2, 3)", okc="c.canonical_rank IN (0, 1, 2, 3)")
_KINDS = "canonical_kind IN ('DIRECTORY', 'REPOSITORY', 'NAMESPACE')"
_CLU = _UP.format(ok=_KINDS, okc=f"c.{_KINDS}")
add("nearest_visible_ancestor", containment(lambda n, e: visual.visible_ancestors(n, (0, 1, 2, 3))), _NVP + " SELECT cn.id, ancestor, CAST(hops AS INTEGER) AS hops FROM cn LEFT JOIN nvp USING (id)", ("cn",))
add("cluster_of_node", containment(lambda n, e: visual.clusters_of(n)), _CLU + " SELECT cn.id, coalesce(ancestor, 'ecosystem::global') AS cluster FROM cn LEFT JOIN nvp USING (id)", ("cn",))
add("visual_edges", containment(lambda n, e: visual.promoted_links(n, e, (0, 1, 2, 3))), _NVP + """
, lifted AS (SELECT e.id, a.ancestor AS source, b.ancestor AS target, CASE WHEN e.type IN ('MEMBER_OF', 'CONTAINS') THEN 'LINEAGE' ELSE 'KINESIS' END AS category, e.type, a.hops + b.hops AS t FROM ce e JOIN nvp a ON a.id = e.source_id JOIN nvp b ON b.id = e.target_id)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY source, target, category ORDER BY id) AS r FROM lifted WHERE source <> target AND t <= 5)
SELECT source, target, category, type, round(greatest(0.1e0, 1 - t * 0.15e0), 6) AS weight, round(greatest(0.1e0, 1 - t * 0.15e0), 6) AS confidence, CAST(t AS INTEGER) AS transitive_depth FROM ranked WHERE r = 1""", C)
add("visual_nodes", containment(lambda n, e: visual.placed_nodes(n, e, (0, 1, 2, 3))), _CLU + f"""
, {_DEG % ('ce', 'ce')}
, f AS (SELECT id, parent_id IS NULL OR starts_with(parent_id, 'ecosystem') AS top FROM cn WHERE {_KINDS})
, ring AS (SELECT id, top, row_number() OVER (PARTITION BY top ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY top) AS n FROM f)
, centre AS (SELECT id AS cluster, CASE WHEN top THEN 960.0e0 * cos(i * 2 * pi() / n) ELSE (i % 10 - 5) * 120.0e0 END AS cx, CASE WHEN top THEN 960.0e0 * sin(i * 2 * pi() / n) ELSE 180.0e0 END AS cy FROM ring)
, own AS (SELECT cn.id, coalesce(ancestor, 'ecosystem::global') AS cluster, canonical_rank AS level, coalesce(deg.i + deg.o, 0) AS degree FROM cn LEFT JOIN nvp USING (id) LEFT JOIN deg USING (id) WHERE canonical_rank IN (0, 1, 2, 3))
, placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY level, degree DESC, id) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM own)
, orbits AS (SELECT *, CAST(floor(sqrt(i + 1)) AS INTEGER) AS orbit FROM placed)
SELECT o.id, o.cluster, CAST(level AS INTEGER) AS level, degree, 1 + degree / 10 AS mass, orbit, round(coalesce(cx, 0) + orbit * 60 * cos((i % (orbit * 2 + 1)) / (orbit * 2 + 1) * 2 * pi()), 3) AS x, round(coalesce(cy, 0) + orbit * 60 * sin((i % (orbit * 2 + 1)) / (orbit * 2 + 1) * 2 * pi()), 3) AS y, cluster_size
FROM orbits o LEFT JOIN centre c USING (cluster)""", C)

# History ------------------------------------------------------------------------------------------------------------
add("node_changes", weeks(lambda a, b, c, d: history.node_changes(a, c)), f"{W} SELECT id, 'added' AS change FROM n2 WHERE id NOT IN (SELECT id FROM n1) UNION ALL SELECT id, 'removed' FROM n1 WHERE id NOT IN (SELECT id FROM n2)", A)
_DRIFT = f"""{W}
, d AS MATERIALIZED (SELECT c.id, c.name, c.file, round(c.gravity - p.gravity, 6) AS gravity_delta, c.complexity - p.complexity AS complexity_delta, c.fingerprint <> p.fingerprint AS is_modified,
  round((c.gravity - p.gravity) * 0.5e0 + (c.complexity - p.complexity) * 0.5e0, 9) AS velocity FROM n2 c JOIN n1 p USING (id))
, d2 AS MATERIALIZED (SELECT * FROM d WHERE abs(velocity) > 0.001 OR is_modified)
, mv AS MATERIALIZED (SELECT p.id AS from_id, c.id AS to_id, c.name, c.file, c.gravity FROM n2 c JOIN n1 p ON c.fingerprint = p.fingerprint AND c.id <> p.id WHERE c.id NOT IN (SELECT id FROM n1))"""
add("drift", weeks(lambda a, b, c, d: history.drift(a, c)), _DRIFT + " SELECT * FROM d2", A)
def _shaped(nodes):
    """A fingerprint of what a node looks like, without its names."""
    return nodes.withColumn("fingerprint", F.concat_ws("|", "complexity", "tenure_days", "author_count", "semantic_kind"))


add("moves", weeks(lambda a, b, c, d: history.moves(_shaped(a), _shaped(c))),
    f"""{W} SELECT p.id AS from_id, c.id AS to_id, c.name, c.file, c.gravity FROM n2 c JOIN n1 p
ON c.complexity = p.complexity AND c.tenure_days = p.tenure_days AND c.author_count = p.author_count AND c.semantic_kind = p.semantic_kind AND c.id <> p.id
WHERE c.id NOT IN (SELECT id FROM n1)""", A)
add("drift_summary", weeks(lambda a, b, c, d: history.drift_summary(a, c)), _DRIFT + """
SELECT CASE WHEN coalesce(max(velocity), 0) > 0.05 THEN 'DECAYING' ELSE 'STABLE' END AS status, (SELECT count(*) FROM d) AS total_symbols, CAST(count_if(velocity > 0) AS BIGINT) AS decay_count, CAST(count_if(velocity < 0) AS BIGINT) AS improvement_count, (SELECT count(*) FROM mv) AS move_count FROM d2""", A)
add("regression_guard", weeks(lambda a, b, c, d: history.guard(a, c)), _DRIFT + """
, s AS (SELECT avg(velocity) AS risk, sum(velocity) AS total, count_if(velocity > 0.1 * 1.5) AS high, bool_or(complexity_delta > 10) AS bloat, max(velocity) > 0.05 AS decaying, (SELECT count(*) FROM mv) AS moved FROM d2)
SELECT decaying AND risk > 0.1 AS block, round(CASE WHEN decaying THEN risk ELSE 0 END, 6) AS risk,
  array_to_string(list_filter([CASE WHEN decaying AND high > 0 THEN 'critical_velocity' END, CASE WHEN decaying AND bloat THEN 'complexity_bloat' END, CASE WHEN decaying AND total > 0.5 THEN 'footprint_expansion' END, CASE WHEN decaying AND moved > 0 THEN 'renames' END], lambda x: x IS NOT NULL), ',') AS factors FROM s""", A)
_PD = f"""{W}, pd AS MATERIALIZED (SELECT c.id, CASE WHEN abs(round(c.gravity - p.gravity, 6)) > 0.01 THEN round(c.gravity - p.gravity, 6) END AS gravity_shift, nullif(c.complexity - p.complexity, 0) AS complexity_bloat, nullif(c.churn - p.churn, 0) AS churn_drift FROM n2 c JOIN n1 p USING (id))
, pd2 AS MATERIALIZED (SELECT * FROM pd WHERE gravity_shift IS NOT NULL OR complexity_bloat IS NOT NULL OR churn_drift IS NOT NULL)"""
add("property_drift", weeks(lambda a, b, c, d: history.property_drift(a, c)), _PD + " SELECT * FROM pd2", A)
add("graph_diff", weeks(history.diff), _PD + """
, s AS (SELECT (SELECT count(*) FROM n2 WHERE id NOT IN (SELECT id FROM n1)) AS nodes_added, (SELECT count(*) FROM n1 WHERE id NOT IN (SELECT id FROM n2)) AS nodes_removed,
  (SELECT count(*) FROM e2 WHERE id NOT IN (SELECT id FROM e1)) AS edges_added, (SELECT count(*) FROM e1 WHERE id NOT IN (SELECT id FROM e2)) AS edges_removed, (SELECT count(*) FROM pd2) AS drifted)
SELECT *, 'Delta: +' || nodes_added || '/-' || nodes_removed || ' Symbols, +' || edges_added || '/-' || edges_removed || ' Relationships. ' || drifted || ' symbols showed structural drift.' AS summary FROM s""", A)
add("trend_audit", lambda s, d: history.trend(graph(s, d, "an"), graph(s, d, "asn")), """
, h AS (SELECT n.id, n.name, n.file, n.gravity, n.complexity, lag(n.gravity) OVER w AS g, lag(n.complexity) OVER w AS c FROM an n JOIN (SELECT * FROM asn ORDER BY ts DESC LIMIT 5) s ON n.snapshot_id = s.id WINDOW w AS (PARTITION BY n.id ORDER BY s.ts))
, r AS (SELECT id, name, file, round(0.6e0 * avg(gravity - g) + 0.4e0 * avg(complexity - c), 6) AS avg_velocity, count(*) AS data_points FROM h WHERE g IS NOT NULL GROUP BY id, name, file)
SELECT id, name, file, avg_velocity, CASE WHEN avg_velocity > 0.1 THEN 'ACCELERATING' ELSE 'STABLE' END AS trend, data_points FROM r WHERE avg_velocity > 0.05 ORDER BY avg_velocity DESC, id LIMIT 20""", ("an", "asn"))
add("previous_risk", lambda s, d: history.previous_risk(graph(s, d, "an"), graph(s, d, "asn"), SYM), f" SELECT n.snapshot_id, n.risk FROM an n JOIN asn s ON n.snapshot_id = s.id WHERE n.id = '{SYM}' ORDER BY s.ts DESC LIMIT 1 OFFSET 1", ("an", "asn"))
add("layer_evolution", lambda s, d: diagnostics.layer_evolution(graph(s, d, "an"), graph(s, d, "asn")), " SELECT n.snapshot_id, s.ts, canonical_kind, count(*) AS n FROM an n JOIN (SELECT * FROM asn ORDER BY ts DESC LIMIT 5) s ON n.snapshot_id = s.id GROUP BY ALL", ("an", "asn"))

# Metrics ------------------------------------------------------------------------------------------------------------
_D2 = f"{W}, {_DEG % ('e2', 'e2')}"
_FAN = "coalesce(deg.o, 0)"
_PARTS = f"0.25e0 * gravity AS gravity_part, 0.35e0 * least(complexity / 20, 1) AS complexity_part, 0.15e0 * least({_FAN} / 10, 1) AS fan_out_part, 0.0e0 AS debt_part, 0.1e0 * least(churn / 100, 1) AS churn_part, 0.1e0 * entropy AS entropy_part"
add("risk_advisor", activity(metrics.risk_advisor), _D2 + f""" SELECT id, name, round(gravity_part, 9) AS gravity_part, round(complexity_part, 9) AS complexity_part, round(fan_out_part, 9) AS fan_out_part, debt_part, round(churn_part, 9) AS churn_part, round(entropy_part, 9) AS entropy_part,
  round(gravity_part + complexity_part + fan_out_part + churn_part + entropy_part, 9) AS risk FROM (SELECT n2.id, name, {_PARTS} FROM n2 LEFT JOIN deg USING (id))""", A)
add("risk_basic", activity(lambda n, e: metrics.risk_basic(n, e).select("id", "risk", F.array_join("factors", ",").alias("factors"))), _D2 + f""" SELECT n2.id, round(0.4e0 * gravity + 0.3e0 * entropy + 0.2e0 * least(churn / 100, 1) + 0.1e0 * least({_FAN} / 10, 1), 9) AS risk,
  array_to_string(list_filter([CASE WHEN gravity > 0.7 THEN 'gravity' END, CASE WHEN entropy > 0.6 THEN 'ownership' END, CASE WHEN churn > 50 THEN 'churn' END, CASE WHEN {_FAN} > 8 THEN 'fan_out' END, CASE WHEN complexity > 50 THEN 'complexity' END], lambda x: x IS NOT NULL), ',') AS factors FROM n2 LEFT JOIN deg USING (id)""", A)


def _suspects(n, e):
    """The activity graph with conditional edges and sequential bodies, so that fallbacks occur."""
    return n.withColumn("name", F.concat("name", F.when(F.col("is_static"), " fallback legacy old").otherwise(""))).withColumn("is_sequential", F.col("complexity") > 2), e.withColumn("is_conditional", F.col("weight") < 2)


_FB = f"""{W}
, x AS MATERIALIZED (SELECT *, name || CASE WHEN is_static THEN ' fallback legacy old' ELSE '' END AS nm FROM n2)
, s AS (SELECT e.target_id AS id, count(*) AS incoming, count_if(e.type = 'CALLS') AS calls, count_if(e.type = 'CALLS' AND c.id IS NOT NULL) AS callers, count_if(e.type = 'CALLS' AND c.complexity > 2) AS late, count_if(e.type = 'CALLS' AND e.weight < 2) AS cond FROM e2 e LEFT JOIN x c ON c.id = e.source_id GROUP BY 1)
, y AS (SELECT x.*, coalesce(CASE WHEN callers > 0 THEN late / callers END, 0) AS late_, coalesce(cond / greatest(incoming, 1), 0) AS cond_, coalesce(cond / greatest(calls, 1), 0) AS ratio_, CASE WHEN is_static THEN 0.4e0 ELSE 0.0e0 END + CASE WHEN contains(name, 'never') THEN 0.2e0 ELSE 0 END AS naming_ FROM x LEFT JOIN s USING (id))
, fb AS MATERIALIZED (SELECT *, CAST(late_ > 0.7 AS INT) + CAST(cond_ > 0.5 AS INT) + CAST(naming_ > 0.3 AS INT) + CAST(ratio_ > 0.5 AS INT) >= 3 AS is_fallback, round(least(1, 0.3e0 * late_ + 0.25e0 * cond_ + 0.1e0 * naming_ + 0.1e0 * ratio_), 6) AS conf, round(ratio_, 6) AS ratio FROM y)"""
add("fallback_detector", activity(lambda n, e: metrics.fallbacks(*_suspects(n, e)).select("id", "is_fallback", "fallback_confidence", "fallback_ratio", "naming_score")), _FB + " SELECT id, is_fallback, conf AS fallback_confidence, ratio AS fallback_ratio, naming_ AS naming_score FROM fb", A)
add("suspicious_fallbacks", activity(lambda n, e: templates.suspicious_fallbacks(metrics.fallbacks(*_suspects(n, e)), e, "w2", 0.2, 1)), _FB + """
SELECT id, nm AS name, file, risk, gravity, complexity, canonical_kind, canonical_rank, tenure_days, conf AS fallback_confidence, ratio AS fallback_ratio, naming_ AS naming_score FROM fb
WHERE is_fallback AND conf >= 0.2 AND tenure_days >= 1 AND canonical_kind IN ('BEHAVIOR', 'STRUCTURE') ORDER BY conf DESC, risk DESC, id LIMIT 10""", A)
add("risk_composite", activity(lambda n, e: metrics.risk_composite(*_suspects(n, e))), _FB + f""", {_DEG % ('e2', 'e2')}
, z AS (SELECT fb.*, {_FAN} AS fan, CASE WHEN is_fallback THEN least(1, CASE WHEN conf > 0.7 THEN (1 - ratio) * 0.4e0 ELSE 0 END + CASE WHEN complexity > 10 THEN least((complexity - 10) / 20, 0.3e0) ELSE 0 END) ELSE 0 END AS fr FROM fb LEFT JOIN deg USING (id))
SELECT id, is_fallback, round(fr, 6) AS fallback_risk, round(CASE WHEN is_fallback THEN 0.15e0 * gravity + 0.30e0 * least(complexity / 20, 1) + 0.1e0 * entropy + 0.1e0 * least(churn / 100, 1) + 0.1e0 * least(fan / 10, 1) + 0.25e0 * fr
  ELSE 0.25e0 * gravity + 0.35e0 * least(complexity / 20, 1) + 0.1e0 * entropy + 0.1e0 * least(churn / 100, 1) + 0.15e0 * least(fan / 10, 1) + 0.05e0 * fr END, 6) AS risk FROM z""", A)
add("split_scores", containment(lambda n, e: metrics.split_scores(n.withColumns({"entropy": F.lit(0.2), "churn": F.lit(10)}), e)), """
, c AS (SELECT e.source_id AS id, coalesce(count_if(s.file = t.file), 0) AS internal, count(*) AS total FROM ce e JOIN cn s ON s.id = e.source_id LEFT JOIN cn t ON t.id = e.target_id GROUP BY 1)
SELECT cn.id, name, round(greatest(0, least(1, 0.4e0 * gravity + 0.3e0 * 0.2e0 + 0.02e0 - 0.5e0 * coalesce(internal / total, 1) + 0.5e0)), 9) AS score, round(coalesce(internal / total, 1), 9) AS cohesion, round(1 - coalesce(internal / total, 1), 9) AS coupling FROM cn LEFT JOIN c USING (id)""", C)
add("ownership_entropy", lambda s, d: metrics.entropy(metrics.ownership(graph(s, d, "co")), "path"), """
, o AS (SELECT path, author, count(*) AS n FROM co GROUP BY 1, 2), p AS (SELECT path, n / sum(n) OVER (PARTITION BY path) AS p FROM o), h AS (SELECT path, -sum(p * log2(p)) AS h, count(*) AS authors FROM p GROUP BY 1)
SELECT path, round(greatest(h, 0), 6) AS entropy, round(CASE WHEN authors > 1 THEN h / log2(authors) ELSE 0 END, 6) AS entropy_risk, authors FROM h""", ("co",))
add("churn", lambda s, d: metrics.churn(graph(s, d, "co")), " SELECT path, count(*) AS commits, count(DISTINCT author) AS authors FROM co GROUP BY 1", ("co",))
add("author_distribution", lambda s, d: metrics.ownership(graph(s, d, "co")), " SELECT path, author, count(*) AS n FROM co GROUP BY 1, 2", ("co",))


def _blame(s, d):
    co = graph(s, d, "co")
    return co.select("path", (F.pmod(F.unix_timestamp("ts"), F.lit(100)) + 1).cast("int").alias("line"), "author", F.unix_timestamp("ts").alias("ts"))


_NOW = 1_710_000_000
add("blame_rollup", lambda s, d: metrics.blame_rollup(week(s, d)[0], _blame(s, d), _NOW), f"""{W}
, b AS (SELECT path, CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 100 + 1 AS INT) AS line, author, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts FROM co)
, e AS (SELECT n2.id, author, count(*) AS n, min(ts) AS f, max(ts) AS l FROM n2 JOIN b ON b.path = n2.file AND b.line BETWEEN n2.line_start AND n2.line_end GROUP BY 1, 2)
SELECT id, CAST(sum(n) AS BIGINT) AS lines, count(*) AS author_count, (list(author ORDER BY n DESC, author))[1] AS primary_author, max(l) AS last_modified, CAST(floor(({_NOW} - min(f)) / 86400) AS INTEGER) AS tenure_days FROM e GROUP BY id""", EV)
add("cochange_pairs", lambda s, d: history.cochange(graph(s, d, "co")), """
, o AS (SELECT DISTINCT hash, path FROM co) SELECT a.path AS file_a, b.path AS file_b, count(*) AS n FROM o a JOIN o b ON a.hash = b.hash AND a.path < b.path GROUP BY 1, 2 HAVING count(*) > 3 ORDER BY n DESC, file_a, file_b LIMIT 100""", ("co",))
add("hidden_coupling", lambda s, d: history.hidden_coupling(graph(s, d, "co"), *week(s, d)), f"""{W}
, o AS (SELECT DISTINCT hash, path FROM co), p AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS n FROM o a JOIN o b ON a.hash = b.hash AND a.path < b.path GROUP BY 1, 2 HAVING count(*) > 3 ORDER BY n DESC, file_a, file_b LIMIT 100)
, l AS (SELECT DISTINCT least(s.file, t.file) AS x, greatest(s.file, t.file) AS y FROM e2 JOIN n2 s ON s.id = e2.source_id JOIN n2 t ON t.id = e2.target_id WHERE s.file <> t.file)
SELECT file_a, file_b, least(n / 10, 1) AS confidence FROM p WHERE (file_a, file_b) NOT IN (SELECT (x, y) FROM l)""", EV)
ORACLES["hidden_coupling"] = ORACLES["hidden_coupling"].replace("WHERE (file_a, file_b) NOT IN (SELECT (x, y) FROM l)", "WHERE NOT EXISTS (SELECT 1 FROM l WHERE x = file_a AND y = file_b)")
add("cohesion_jaccard", activity(lambda n, e: metrics.similarity(e, SYM, "user::25::view")), f"""{W}
, t AS (SELECT target_id, bool_or(source_id = '{SYM}') AS x, bool_or(source_id = 'user::25::view') AS y FROM e2 WHERE source_id IN ('{SYM}', 'user::25::view') GROUP BY 1) SELECT round(coalesce(count_if(x AND y) / count(*), 0), 6) AS similarity FROM t""", A)
add("type_histogram", activity(lambda n, e: metrics.type_histogram(n)), f"{W} SELECT semantic_kind, count(*) AS n FROM n2 GROUP BY 1", A)
add("graph_similarity", weeks(lambda a, b, c, d: metrics.graph_similarity(a, b, c, d)), f"""{W}
, g AS (SELECT (SELECT count(*) FROM e1) / (SELECT count(*) FROM n1) AS da, (SELECT count(*) FROM e2) / (SELECT count(*) FROM n2) AS db,
  3 * (SELECT count(*) FROM e1) / (SELECT count(*) FROM n1) AS ea, 3 * (SELECT count(*) FROM e2) / (SELECT count(*) FROM n2) AS eb)
, t AS (SELECT sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) / sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))) AS t FROM (SELECT semantic_kind, count(*) AS n FROM n1 GROUP BY 1) x FULL JOIN (SELECT semantic_kind, count(*) AS n FROM n2 GROUP BY 1) y USING (semantic_kind))
, s AS (SELECT 1 - abs(da - db) / greatest(da, db, 1) AS d, 1 - abs(ea - eb) / greatest(ea, eb, 1) AS k, t FROM g, t)
, v AS (SELECT *, 0.3e0 * d + 0.3e0 * k + 0.4e0 * t AS total FROM s)
SELECT CAST(floor(total * 100 + 0.5) AS INTEGER) AS similarity, round(d, 6) AS density, round(k, 6) AS kinetic, round(t, 6) AS typology, CASE WHEN total > 0.9 THEN 'identical' WHEN total > 0.7 THEN 'strong' WHEN total > 0.4 THEN 'partial' ELSE 'weak' END AS verdict FROM v""", A)

# Governance ---------------------------------------------------------------------------------------------------------
add("hub_advice", containment(governance.hubs), f"""
, {_DEG % ('ce', 'ce')}, d AS (SELECT count(*) AS d FROM ce GROUP BY source_id), m AS (SELECT list_sort(list(d))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS m FROM d)
SELECT id, i + o AS degree FROM deg JOIN cn USING (id), m WHERE i + o > greatest(5 * m, 10)""", C)
RULES = [
    {"id": "exported", "type": "require_export", "matchPath": "^user::1", "matchLabel": "BEHAVIOR"},
    {"id": "heritage", "type": "require_heritage", "matchPath": "^user::2", "matchLabel": "class", "target": "signup"},
    {"id": "fans", "type": "max_fans", "matchPath": "^user::", "max": 6},
    {"id": "caller", "type": "require_caller", "matchPath": "::25::", "target": "click_25"},
    {"id": "file", "type": "require_file", "target": "config/rules.json"},
]
add("policy_violations", activity(lambda n, e: governance.policy_violations(n, e, RULES).select("node_id", "rule_id")), f"""{W}
SELECT id AS node_id, 'exported' AS rule_id FROM n2 WHERE id LIKE 'user::1%' AND canonical_kind = 'BEHAVIOR' AND NOT is_exported
UNION ALL SELECT id, 'heritage' FROM n2 WHERE id LIKE 'user::2%' AND semantic_kind = 'class' AND id NOT IN (SELECT source_id FROM e2 WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'TYPE_REFERENCE') AND target_id LIKE '%::signup')
UNION ALL SELECT n2.id, 'fans' FROM n2 JOIN (SELECT target_id AS id, count(*) AS n FROM e2 GROUP BY 1) USING (id) WHERE n > 6
UNION ALL SELECT id, 'caller' FROM n2 WHERE contains(id, '::25::') AND id NOT IN (SELECT target_id FROM e2 JOIN n2 s ON s.id = source_id WHERE s.name = 'click_25')
UNION ALL SELECT 'global', 'file' WHERE NOT EXISTS (SELECT 1 FROM n2 WHERE file = 'config/rules.json')""", A)


def _broken(n, e):
    """The activity graph without its infrastructure nodes, so that edges dangle."""
    return n.where("canonical_kind <> 'INFRA'"), e


add("structural_audit", activity(lambda n, e: governance.audit(*_broken(n, e)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))), _SCC + """
SELECT 'CIRCULAR' AS type, count(DISTINCT component) AS n FROM scc WHERE size > 1
UNION ALL SELECT 'ECOSYSTEM', count(*) FROM e2 WHERE target_id NOT IN (SELECT id FROM n2 WHERE canonical_kind <> 'INFRA')""", A)
add("dangling_edges", activity(lambda n, e: diagnostics.dangling_edges(*_broken(n, e))), f"""{W}, k AS (SELECT id FROM n2 WHERE canonical_kind <> 'INFRA')
SELECT id, 'source' AS side FROM e2 WHERE source_id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'target' FROM e2 WHERE target_id NOT IN (SELECT id FROM k)""", A)
add("dead_code_findings", activity(governance.dead_code), f"""{W}
, s AS (SELECT e.target_id AS id, count(*) AS i, count_if(s.file IS NOT NULL AND s.file <> t.file) AS x FROM e2 e JOIN n2 t ON t.id = e.target_id LEFT JOIN n2 s ON s.id = e.source_id GROUP BY 1)
SELECT id, CASE WHEN coalesce(i, 0) = 0 THEN 'ORPHAN' ELSE 'UNUSED_EXPORT' END AS finding FROM n2 LEFT JOIN s USING (id) WHERE coalesce(i, 0) = 0 OR (is_exported AND x = 0)""", A)
add("external_coupling", containment(governance.external_coupling), " SELECT source_id AS id, count(*) AS n FROM ce WHERE type = 'DEPENDS_ON' GROUP BY 1 HAVING count(*) > 5", C)
add("governance_status", activity(lambda n, e: governance.status(n, e, 3)), f"{W} SELECT (SELECT count(*) FROM n2) AS node_count, (SELECT count(*) FROM e2) AS edge_count, round((SELECT count(*) FROM e2) / (SELECT count(*) FROM n2), 6) AS density, TRUE AS stale, CAST(3 AS INTEGER) AS commits_behind", A)
add("governance_context", activity(lambda n, e: governance.context(n)), f"""{W}
(SELECT 'gravity' AS section, id, name, round(gravity, 6) AS value FROM n2 ORDER BY gravity DESC, id LIMIT 10) UNION ALL (SELECT 'risk', id, name, round(risk, 6) FROM n2 ORDER BY risk DESC, id LIMIT 10) UNION ALL SELECT 'violations', id, name, round(risk, 6) FROM n2 WHERE risk > 0.8""", A)
add("advice", activity(lambda n, e: governance.advice(n, e).groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n"))))

# Diagnostics --------------------------------------------------------------------------------------------------------
_FUNC = "('CALLS', 'USES', 'IMPORTS', 'IMPLEMENTS', 'EXTENDS', 'TYPE_REFERENCE', 'CONSTRUCTS')"
add("layer_census", containment(diagnostics.layer_census), f"""
, t AS (SELECT source_id AS id FROM ce WHERE type IN {_FUNC} UNION SELECT target_id FROM ce WHERE type IN {_FUNC}), s AS (SELECT canonical_kind, canonical_rank, count(*) AS total, count(*) FILTER (t.id IS NULL) AS orphans FROM cn LEFT JOIN t USING (id) GROUP BY 1, 2)
SELECT canonical_kind, canonical_rank, total, orphans, round(100.0e0 * (total - orphans) / total, 4) AS health FROM s""", C)
add("shadow_symbols", containment(lambda n, e: diagnostics.shadow_symbols(n)), """
 SELECT name, count(*) AS n, string_agg(DISTINCT file, ', ' ORDER BY file) AS files FROM cn WHERE canonical_kind IN ('STRUCTURE', 'BEHAVIOR') GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, name LIMIT 10""", ("cn",))
add("orphan_hitlist", containment(diagnostics.orphan_list), f" SELECT id, name, canonical_kind FROM cn WHERE canonical_kind IN ('BEHAVIOR', 'STRUCTURE') AND id NOT IN (SELECT target_id FROM ce WHERE type IN {_FUNC}) AND id NOT IN (SELECT source_id FROM ce WHERE type IN {_FUNC})", C)
add("column_occupancy", containment(lambda n, e: metrics.column_occupancy(n, ["parent_id", "unit_id", "file", "structure_id"])), """
, s AS (SELECT count(*) AS total, count(parent_id) AS a, count(unit_id) AS b, count(file) AS c, count(structure_id) AS d FROM cn)
SELECT 'parent_id' AS column_name, a AS filled, total FROM s UNION ALL SELECT 'unit_id', b, total FROM s UNION ALL SELECT 'file', c, total FROM s UNION ALL SELECT 'structure_id', d, total FROM s""", ("cn",))
add("broken_parents", activity(lambda n, e: diagnostics.broken_parents(n)), f"{W} SELECT id, parent_id FROM n2 WHERE parent_id NOT IN (SELECT id FROM n2)", A)
# by membership alone: parts are no one's members, so they hang on nothing
add("disconnected_nodes", containment(lambda n, e: diagnostics.disconnected(n, e.where("type = 'MEMBER_OF'"))), """
SELECT id, canonical_kind FROM cn WHERE id NOT IN (SELECT source_id FROM ce WHERE type = 'MEMBER_OF') AND id NOT IN (SELECT target_id FROM ce WHERE type = 'MEMBER_OF')""", C)
add("id_collisions", lambda s, d: diagnostics.id_collisions(s.read.parquet(f"{d}/lineitem.parquet").select(F.lit("x").alias("snapshot_id"), F.concat_ws("::", "l_orderkey", "l_linenumber").alias("id"))), "SELECT 'x' AS snapshot_id, l_orderkey || '::' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add("illegal_parents", containment(lambda n, e: diagnostics.illegal_parents(n)), " SELECT id, 'no_parent' AS fault FROM cn WHERE canonical_rank >= 4 AND parent_id IS NULL", ("cn",))
add("stale_edges", lambda s, d: diagnostics.stale_edges(graph(s, d, "ae"), "w2"), " SELECT snapshot_id, count(*) AS n FROM ae WHERE snapshot_id <> 'w2' GROUP BY 1", A)
add("symbol_connectivity", activity(lambda n, e: diagnostics.connectivity(n, e, SYM)), f"{W} SELECT count(*) AS incoming, count(DISTINCT n2.file) AS files FROM e2 JOIN n2 ON n2.id = e2.source_id WHERE target_id = '{SYM}'", A)
add("pointer_coverage", containment(lambda n, e: diagnostics.coverage(n)), " SELECT canonical_kind, count(*) AS total, CAST(count_if(parent_id IS NULL) AS BIGINT) AS no_parent_id, CAST(count_if(unit_id IS NULL) AS BIGINT) AS no_unit_id, CAST(count_if(file IS NULL) AS BIGINT) AS no_file FROM cn GROUP BY 1", ("cn",))
add("orphans_by_kind", containment(lambda n, e: diagnostics.orphans_by_kind(n)), " SELECT canonical_kind, count(*) AS n FROM cn WHERE parent_id IS NULL GROUP BY 1", ("cn",))
add("edges_by_type", containment(lambda n, e: diagnostics.edges_by_type(e)), " SELECT type, count(*) AS n FROM ce GROUP BY 1", C)
add("units_outside", containment(lambda n, e: diagnostics.units_outside(n, e.where("id <> 'm::customer::3'"))), " SELECT id FROM cn WHERE id = 'customer::3'", C)
add("store_totals", lambda s, d: diagnostics.totals(graph(s, d, "an"), graph(s, d, "ae"), graph(s, d, "asn")), " SELECT (SELECT count(*) FROM an) AS nodes, (SELECT count(*) FROM ae) AS edges, (SELECT count(*) FROM asn) AS snapshots", ("an", "ae", "asn"))

# Search -------------------------------------------------------------------------------------------------------------
add("ranked_search", activity(lambda n, e: search.ranked(n, e, "click_25 error BEHAVIOR 6")), f"""{W}
, q(t) AS (VALUES ('click_25'), ('error'), ('behavior'), ('6'))
, own AS MATERIALIZED (SELECT id, sum(CASE WHEN name = t THEN 100 WHEN contains(name, t) THEN 20 ELSE 0 END + CASE WHEN contains(semantic_kind, t) THEN 5 ELSE 0 END + CASE WHEN contains(file, t) THEN 10 ELSE 0 END + CASE WHEN lower(canonical_kind) = t THEN 50 ELSE 0 END + CASE WHEN CAST(canonical_rank AS VARCHAR) = t THEN 10 ELSE 0 END)
  * any_value(CASE WHEN gravity = 0 THEN 1 ELSE gravity END) AS score FROM n2, q GROUP BY id)
, sums AS (SELECT id, score FROM own WHERE score > 0 UNION ALL SELECT e.source_id, o.score * 0.5e0 FROM own o JOIN e2 e ON e.target_id = o.id WHERE o.score * 0.5e0 >= 1)
SELECT id, round(sum(score), 6) AS score FROM sums GROUP BY id ORDER BY score DESC, id LIMIT 20""", A)
add("find_nodes_by_name", activity(lambda n, e: search.by_name(n, "CLICK_1").select("id", "name")), f"{W} SELECT id, name FROM n2 WHERE contains(name, 'click_1') ORDER BY id LIMIT 20", A)
add("pattern_match", activity(lambda n, e: search.pattern(n, e, "(class)-[:CONSTRUCTS]->(behavior)")), f"""{W}
SELECT e.source_id, s.name AS source, e.type, e.target_id, t.name AS target, s.file AS source_file, t.file AS target_file, e.confidence FROM e2 e JOIN n2 s ON s.id = e.source_id JOIN n2 t ON t.id = e.target_id
WHERE e.type = 'CONSTRUCTS' AND (contains(s.semantic_kind, 'class') OR contains(lower(s.canonical_kind), 'class')) AND (contains(t.semantic_kind, 'behavior') OR contains(lower(t.canonical_kind), 'behavior'))""", A)
add("symbol_at_line", activity(lambda n, e: search.symbols_at(n, n.select("file", (F.col("line_start") + 4).alias("line")))), f"""{W}
, p AS (SELECT DISTINCT file, line_start + 4 AS line FROM n2), r AS (SELECT p.file, p.line, n2.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY line_end - line_start, n2.id) AS r FROM p JOIN n2 ON n2.file = p.file AND p.line BETWEEN line_start AND line_end)
SELECT file, line, id FROM r WHERE r = 1""", A)

# Linking and the store ----------------------------------------------------------------------------------------------
add("snapshot_carry_forward", weeks(lambda a, b, c, d: store.carry_forward(a.drop("snapshot_id"), c.where("unit_id LIKE 'user::1%'").drop("snapshot_id"), c.where("unit_id LIKE 'user::1%'").select("unit_id").distinct()).select("id", "risk")), f"""{W}
, u AS (SELECT DISTINCT unit_id FROM n2 WHERE unit_id LIKE 'user::1%') SELECT id, risk FROM n2 WHERE unit_id LIKE 'user::1%' UNION ALL SELECT id, risk FROM n1 WHERE unit_id NOT IN (SELECT unit_id FROM u)""", A)
add("purge_units", activity(lambda n, e: store.purge_units(n, e, n.where("unit_id LIKE 'user::1%'").select("unit_id").distinct())[1].select("id")), f"{W} SELECT id FROM e2 WHERE source_id NOT LIKE 'user::1%'", A)
add("federation_union", weeks(lambda a, b, c, d: store.federate([a, c]).select("id", "snapshot_id")), f"{W} SELECT id, 'w2' AS snapshot_id FROM n2 UNION ALL SELECT id, 'w1' FROM n1 WHERE id NOT IN (SELECT id FROM n2)", A)
add("rebind_edges", activity(lambda n, e: linking.rebind(e, e.where("type = 'CALLS'").select("id", F.concat(F.lit("new::"), "target_id").alias("new_target_id"))).select("id", "target_id")), f"{W} SELECT id, CASE WHEN type = 'CALLS' THEN 'new::' || target_id ELSE target_id END AS target_id FROM e2", A)


def _hrefs(s, d):
    links = s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("page::"), "page_id").alias("source_id"), F.explode(F.expr("regexp_extract_all(html, r'href=\"([^\"]+)\"', 1)")).alias("target_id"))
    return links.select(F.col("source_id").alias("id"), "source_id", "target_id")


add("virtual_libraries", lambda s, d: linking.virtual_libraries(s.createDataFrame([], "id string"), _hrefs(s, d).select(F.regexp_replace("target_id", "^/", "npm::").alias("target_id"))).select("id", "name", "parent_id", "canonical_rank"), """
WITH h AS (SELECT DISTINCT lower(regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '^/', 'npm::')) AS id FROM pages)
, p AS (SELECT id, string_split(id, '::') AS p FROM h), s AS (SELECT id, CASE WHEN len(p) >= 2 THEN p[1] ELSE 'unresolved' END AS ns, CASE WHEN len(p) >= 2 THEN p[2] ELSE id END AS sym FROM p WHERE CASE WHEN len(p) >= 2 THEN p[1] IN ('global', 'npm', 'std', 'pip', 'gem', 'mvn', 'go', 'crates') ELSE NOT starts_with(id, '/') AND NOT starts_with(id, 'c:\\') END)
SELECT id, sym AS name, 'lib::' || ns AS parent_id, CAST(7 AS INTEGER) AS canonical_rank FROM s UNION ALL SELECT DISTINCT 'lib::' || ns, ns, NULL, 1 FROM s""")
add("directory_clustering", activity(lambda n, e: clustering.cluster_files(n.withColumn("file", F.concat(F.lit("src/lib/"), "file", F.lit("/"), "name")), e)))

_BARE = "regexp_replace(target_id, '^user::', '')"
add("prefix_local_targets", activity(lambda n, e: linking.prefix_local_targets(n, e.withColumn("target_id", F.expr(_BARE))).select("id", "target_id")), f"""{W}
SELECT id, CASE WHEN 'user::' || lower({_BARE}) IN (SELECT id FROM n2) THEN 'user::' || lower({_BARE}) ELSE {_BARE} END AS target_id FROM e2""", A)
add("gravity_from_energy", activity(lambda n, e: linking.set_gravity(n, G.energy(e).select("id", F.col("energy").cast("double").alias("gravity"))).select("id", F.round("gravity", 9).alias("gravity"))), f"""{W}
, ends AS (SELECT source_id AS id, 1 AS w FROM e2 UNION ALL SELECT target_id, 2 FROM e2), rolled AS (SELECT id, CAST(sum(w) AS DOUBLE) AS energy FROM ends GROUP BY id)
SELECT n2.id, round(coalesce(energy, gravity), 9) AS gravity FROM n2 LEFT JOIN rolled USING (id)""", A)
