"""Registered queries: the template library over the fixture graphs, with their oracles."""

from __future__ import annotations

from ..operators import templates as T
from .fixtures import graph, prefix

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _activity(f, *args, **kw):
    return lambda spark, d: f(graph(spark, d, "an"), graph(spark, d, "ae"), "w2", *args, **kw)


def _containment(f, *args, **kw):
    return lambda spark, d: f(graph(spark, d, "cn"), graph(spark, d, "ce"), "g1", *args, **kw)


def add(name: str, query, sql: str | None = None, needs: tuple[str, ...] = ()) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"{prefix(*needs)}\n{sql}" if needs else sql


A, C = ("an", "ae"), ("cn", "ce")
IN_W2 = "JOIN an n ON e.source_id = n.id AND e.snapshot_id = n.snapshot_id WHERE e.snapshot_id = 'w2'"
CODE = "canonical_kind IN ('BEHAVIOR', 'STRUCTURE')"

add("find_usages", _activity(T.find_usages, "user::25::error", "CALLS"), f"""
SELECT n.id, n.name, n.file, n.structure_id, n.namespace_id, n.risk, n.canonical_kind, n.canonical_rank FROM ae e {IN_W2}
AND e.target_id = 'user::25::error' AND e.type = 'CALLS' ORDER BY n.risk DESC, n.id LIMIT 10""", A)
add("find_usages_of_part", _containment(T.find_usages, "part::7", "CALLS"), """
SELECT n.id, n.name, n.file, n.structure_id, n.namespace_id, n.risk, n.canonical_kind, n.canonical_rank FROM ce e JOIN cn n ON e.source_id = n.id
WHERE e.target_id = 'part::7' AND e.type = 'CALLS' ORDER BY n.risk DESC, n.id LIMIT 10""", C)
add("find_imports", _activity(T.find_imports, "user::25::error"), f"""
SELECT n.id, n.name, n.file, n.namespace_id, n.risk, n.gravity, n.canonical_kind, n.canonical_rank FROM ae e {IN_W2}
AND e.target_id = 'user::25::error' AND e.type = 'IMPORTS' ORDER BY n.gravity DESC, n.id LIMIT 10""", A)
add("unused_exports", _activity(T.unused_exports), f"""
SELECT id, name, file, risk, tenure_days, canonical_kind, canonical_rank FROM an WHERE snapshot_id = 'w2' AND is_exported AND {CODE}
AND id NOT IN (SELECT target_id FROM ae WHERE type = 'IMPORTS' AND snapshot_id = 'w2') ORDER BY risk DESC, id LIMIT 10""", A)
add("dead_code", _activity(T.dead_code, 1), f"""
SELECT id, name, file, risk, gravity, complexity, canonical_kind, semantic_kind, structure_id, tenure_days, primary_author FROM an
WHERE snapshot_id = 'w2' AND NOT is_entry_point AND {CODE} AND tenure_days >= 1
AND id NOT IN (SELECT target_id FROM ae WHERE snapshot_id = 'w2') ORDER BY risk DESC, tenure_days DESC, id LIMIT 10""", A)
add("high_risk_dead_code", _activity(T.high_risk_dead_code, 1, 0), """
SELECT id, name, file, risk, complexity, tenure_days, primary_author FROM an
WHERE snapshot_id = 'w2' AND NOT is_entry_point AND complexity >= 1 AND tenure_days >= 0
AND id NOT IN (SELECT target_id FROM ae WHERE snapshot_id = 'w2') ORDER BY risk DESC, id LIMIT 10""", A)
add("blast_radius", _activity(T.blast_radius, "user::25::error"), f"""
SELECT n.id, n.name, n.file, n.risk, n.structure_id, n.namespace_id, e.weight, e.type, n.canonical_kind, n.canonical_rank FROM ae e {IN_W2}
AND e.target_id = 'user::25::error' ORDER BY e.weight DESC, n.risk DESC, n.id, e.type LIMIT 10""", A)
add("deep_impact", _activity(T.deep_impact, "user::25::error", 5), """
, impact AS (
  SELECT source_id AS id, 1 AS depth FROM ae WHERE target_id = 'user::25::error' AND snapshot_id = 'w2'
  UNION SELECT e.source_id, i.depth + 1 FROM ae e JOIN impact i ON e.target_id = i.id WHERE i.depth < 5 AND e.snapshot_id = 'w2'
)
SELECT n.id, n.name, n.file, n.risk, n.canonical_kind, n.namespace_id, CAST(min(i.depth) AS INTEGER) AS hop_distance
FROM impact i JOIN an n ON i.id = n.id AND n.snapshot_id = 'w2' GROUP BY ALL ORDER BY hop_distance, n.risk DESC, n.id LIMIT 10""", A)
add("structural_siblings", _containment(T.structural_siblings, "order::3"), """
SELECT id, name, risk, complexity, gravity, semantic_kind, visibility, canonical_kind, canonical_rank FROM cn
WHERE structure_id = (SELECT structure_id FROM cn WHERE id = 'order::3') AND id <> 'order::3'""", ("cn",))
add("symbols_in_structure", _activity(T.symbols_in_structure, "user::3::purchase"), """
SELECT id, name, semantic_kind, risk, gravity, complexity, visibility, is_entry_point, canonical_kind, canonical_rank, is_async, is_static, returns
FROM an WHERE structure_id = 'user::3::purchase' AND snapshot_id = 'w2'""", ("an",))
add("symbols_in_namespace", _activity(T.symbols_in_namespace, "ns::3%", "BEHAVIOR"), """
SELECT id, name, file, canonical_kind, semantic_kind, risk, gravity, complexity, structure_id, canonical_rank FROM an
WHERE namespace_id LIKE 'ns::3%' AND canonical_kind = 'BEHAVIOR' AND snapshot_id = 'w2' ORDER BY gravity DESC, id LIMIT 10""", ("an",))
add("full_ancestry", _containment(T.full_ancestry, "order::3"), """
SELECT n.id, n.name, n.file, n.canonical_kind, n.risk, n.parent_id, n.unit_id, n.namespace_id, n.structure_id,
  p.name AS parent_name, u.name AS file_name, s.name AS namespace_name, c.name AS class_name
FROM cn n LEFT JOIN cn p ON n.parent_id = p.id LEFT JOIN cn u ON n.unit_id = u.id LEFT JOIN cn s ON n.namespace_id = s.id LEFT JOIN cn c ON n.structure_id = c.id
WHERE n.id = 'order::3'""", ("cn",))
add("class_health_rollup", _containment(T.class_health_rollup, "customer::7"), """
SELECT structure_id, round(avg(risk), 6) AS class_risk, CAST(sum(complexity) AS BIGINT) AS total_complexity, count(*) AS method_count, max(gravity) AS peak_gravity, min(risk) AS lowest_method_risk
FROM cn WHERE unit_id = 'customer::7' AND canonical_kind = 'BEHAVIOR' GROUP BY structure_id""", ("cn",))
add("high_risk_symbols", _containment(T.high_risk_symbols, 0.4, "directory::1%"), """
SELECT id, name, file, risk, gravity, complexity, canonical_kind, semantic_kind, structure_id, canonical_rank FROM cn
WHERE risk >= 0.4 AND namespace_id LIKE 'directory::1%' ORDER BY risk DESC, id LIMIT 10""", ("cn",))
add("hotspots", _activity(T.hotspots), f"""
SELECT id, name, file, risk, gravity, complexity, canonical_kind, semantic_kind, structure_id, round(risk * 0.6e0 + gravity * 0.4e0, 6) AS hotspot_score, churn, primary_author
FROM an WHERE {CODE} AND snapshot_id = 'w2' ORDER BY hotspot_score DESC, id LIMIT 10""", ("an",))
add("entry_points", _activity(T.entry_points), """
SELECT id, name, file, gravity, risk, complexity, canonical_kind, semantic_kind, namespace_id FROM an
WHERE is_entry_point AND snapshot_id = 'w2' ORDER BY gravity DESC, id LIMIT 10""", ("an",))
add("find_by_name", _activity(T.find_by_name, "view_1", "ns::", "BEHAVIOR"), """
SELECT id, name, file, risk, gravity, complexity, canonical_kind, semantic_kind, structure_id, namespace_id FROM an
WHERE contains(name, 'view_1') AND contains(namespace_id, 'ns::') AND canonical_kind = 'BEHAVIOR' AND snapshot_id = 'w2' ORDER BY gravity DESC, id LIMIT 10""", ("an",))
add("cross_namespace_coupling", _containment(T.cross_namespace_coupling), """
, s AS MATERIALIZED (SELECT e.target_id, e.weight, n.namespace_id, n.risk FROM ce e JOIN cn n ON e.source_id = n.id WHERE n.namespace_id IS NOT NULL)
SELECT s.namespace_id AS from_namespace, t.namespace_id AS to_namespace, count(*) AS edge_count, round(avg(s.weight), 6) AS avg_coupling, max(s.risk) AS max_source_risk
FROM s JOIN cn t ON s.target_id = t.id WHERE s.namespace_id <> t.namespace_id
GROUP BY ALL ORDER BY edge_count DESC, from_namespace, to_namespace LIMIT 10""", C)
add("layer_distribution", _containment(T.layer_distribution), """
SELECT canonical_rank, canonical_kind, count(*) AS symbol_count, round(avg(risk), 6) AS avg_risk, round(avg(gravity), 6) AS avg_gravity, CAST(count_if(is_entry_point) AS BIGINT) AS entry_point_count
FROM cn GROUP BY canonical_rank, canonical_kind""", ("cn",))
