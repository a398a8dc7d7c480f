"""Graph operators on hand-built and random graphs, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clustering, diagnostics, governance, graph as G, linking, metrics, search, visual

NODE = "id string, canonical_kind string, semantic_kind string, name string, file string, parent_id string, canonical_rank int, gravity double, complexity int, is_entry_point boolean, is_test boolean"


def nodes(spark, rows):
    return spark.createDataFrame([(i, k, s, i.split("::")[-1], f, None, 6, 0.0, 1, False, False) for i, k, s, f in rows], NODE)


def edges(spark, rows):
    return spark.createDataFrame([(f"{t}::{a}->{b}::{n}", a, b, t, 1.0, 1.0) for n, (a, b, t) in enumerate(rows)], "id string, source_id string, target_id string, type string, weight double, confidence double")


def test_hierarchical_cycle_is_no_violation(spark):
    n = nodes(spark, [("file.ts::unit", "STRUCTURE", "unit", "file.ts"), ("file.ts::fn", "BEHAVIOR", "function", "file.ts")])
    e = edges(spark, [("file.ts::fn", "file.ts::unit", "MEMBER_OF"), ("file.ts::unit", "file.ts::fn", "CALLS")])
    assert {r.id for r in G.strong_components(e).collect()} == {"file.ts::unit", "file.ts::fn"}
    assert governance.audit_summary(governance.audit(n, e)).first().asDict() == {"success": True, "cycles": 0, "orphans": 0, "ecosystem_dangling": 0}


def test_real_cycle_is_a_violation(spark):
    n = nodes(spark, [("a", "BEHAVIOR", "function", "a.ts"), ("b", "BEHAVIOR", "function", "b.ts")])
    e = edges(spark, [("a", "b", "CALLS"), ("b", "a", "CALLS")])
    assert governance.audit_summary(governance.audit(n, e)).first()["cycles"] == 1
    assert {r.anomaly for r in governance.mark_cycles(n, e).collect()} == {"cycle"}


def test_orphan_edges_are_internal_or_external(spark):
    n = nodes(spark, [("file_b.ts::caller", "BEHAVIOR", "function", "file_b.ts")])
    e = edges(spark, [("file_b.ts::caller", "file_a.ts::missing", "CALLS"), ("file_b.ts::caller", "/repo/x.ts::gone", "CALLS")])
    found = {r.type for r in governance.audit(n, e, "/repo").collect()}
    assert found == {"ECOSYSTEM", "REFACTOR"}


@pytest.fixture(scope="module")
def random_graph(spark):
    r = random.Random(5)
    ids = [f"n{i:02d}" for i in range(40)]
    rows = [(r.choice(ids), r.choice(ids), r.choice(["CALLS", "IMPORTS", "EXTENDS"])) for _ in range(75)]
    return ids, rows, nodes(spark, [(i, "BEHAVIOR", "function", f"{i}.py") for i in ids]), edges(spark, rows)


def _closure(rows):
    out = {}
    for a, b, _ in rows:
        out.setdefault(a, set()).add(b)
    reach = {}
    for s in {x for a, b, _ in rows for x in (a, b)}:
        seen, todo = set(), list(out.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[s] = seen
    return reach


def test_strong_components_against_reachability(random_graph):
    ids, rows, n, e = random_graph
    reach = _closure(rows)
    want = {}
    for x in reach:
        same = {y for y in reach[x] if x in reach.get(y, ())}
        if same:
            want[x] = (max(same | {x}), len(same | {x}))
    assert {r.id: (r.component, r["size"]) for r in G.strong_components(e).collect()} == want


def test_pagerank_against_plain_python(random_graph):
    ids, rows, n, e = random_graph
    rank = {i: 1 / len(ids) for i in ids}
    out = {i: [b for a, b, _ in rows if a == i] for i in ids}
    for _ in range(30):
        lost = sum(rank[i] for i in ids if not out[i])
        new = {i: 0.15 / len(ids) + 0.85 * lost / len(ids) for i in ids}
        for i in ids:
            for b in out[i]:
                new[b] += 0.85 * rank[i] / len(out[i])
        rank = new
    got = {r.id: r["rank"] for r in G.pagerank(n, e).collect()}
    assert got.keys() == rank.keys()
    assert all(abs(got[i] - rank[i]) < 1e-12 for i in ids)


def test_shortest_against_dijkstra(random_graph):
    import heapq

    ids, rows, n, e = random_graph
    best, todo = {}, [(0.0, "n00")]
    while todo:
        d, x = heapq.heappop(todo)
        if x in best or d > 5:
            continue
        best[x] = d
        for a, b, t in rows:
            if b == x:
                heapq.heappush(todo, (d + G.IMPACT_WEIGHTS[t], a))
    del best["n00"]
    got = {r.id: r.distance for r in G.impact(e, "n00").collect()}
    assert got.keys() == best.keys()
    assert all(math.isclose(got[i], best[i], abs_tol=1e-6) for i in best)


def test_bfs_depths_and_empty_graph(spark, random_graph):
    ids, rows, n, e = random_graph
    got = {r.id: r.depth for r in G.bfs(e, "n01", "downstream", 3).collect()}
    want, frontier = {"n01": 0}, {"n01"}
    for depth in (1, 2, 3):
        frontier = {b for a, b, _ in rows if a in frontier} - want.keys()
        want |= dict.fromkeys(frontier, depth)
    assert got == want
    none = edges(spark, [("a", "b", "CALLS")]).where("false")
    assert G.strong_components(none).count() == 0
    assert [r.id for r in G.bfs(none, "a").collect()] == ["a"]
    assert G.pagerank(n.where("false"), none).count() == 0
    assert G.components(none).count() == 0


def test_topological_levels_put_cycles_last(spark):
    e = edges(spark, [("a", "b", "IMPORTS"), ("b", "c", "IMPORTS"), ("x", "y", "IMPORTS"), ("y", "x", "IMPORTS"), ("z", "x", "IMPORTS")])
    assert {r.id: r.level for r in G.topological_levels(e).collect()} == {"c": 0, "b": 1, "a": 2, "x": 3, "y": 3, "z": 3}


def test_pattern_search_and_names(spark):
    n = nodes(spark, [("a::C", "STRUCTURE", "class", "a"), ("a::f", "BEHAVIOR", "function", "a")])
    e = edges(spark, [("a::f", "a::C", "CONSTRUCTS")])
    assert search.pattern(n, e, "(function)-[:*]->(Class)").count() == 1
    assert search.pattern(n, e, "()-[:CALLS]->()").count() == 0
    with pytest.raises(ValueError):
        search.pattern(n, e, "nonsense")
    assert [r.id for r in search.by_name(n, "C").collect()] == ["a::C"]
    assert [r.id for r in search.by_name(n, "class").collect()] == ["a::C"]


def test_dead_code_precedence(spark):
    n = nodes(spark, [("a::lone", "BEHAVIOR", "function", "a"), ("a::used", "BEHAVIOR", "function", "a"), ("a::main", "BEHAVIOR", "function", "a")]).withColumn("is_exported", F.lit(True))
    e = edges(spark, [("a::main", "a::used", "CALLS")])
    assert {(r.id, r.finding) for r in governance.dead_code(n, e).collect()} == {("a::lone", "ORPHAN"), ("a::used", "UNUSED_EXPORT")}


def test_clusters_merge_linked_neighbours(spark):
    n = nodes(spark, [("1", "BEHAVIOR", "function", "src/a/x.ts"), ("2", "BEHAVIOR", "function", "src/a/y.ts"), ("3", "BEHAVIOR", "function", "lib/z.ts")])
    e = edges(spark, [("1", "2", "CALLS"), ("2", "3", "CALLS")])
    got = {r.file: r.cluster for r in clustering.cluster_files(n, e).collect()}
    # 0.6 + 0.4 * 2/3 merges the folder; then 0.6 * 1/2 doesn't reach 0.5
    assert got["src/a/x.ts"] == got["src/a/y.ts"] and got["lib/z.ts"] == "lib/z.ts"


def test_entropy_of_one_author_is_zero(spark):
    rows = spark.createDataFrame([("p", "a", 4), ("q", "a", 2), ("q", "b", 2)], "path string, author string, n long")
    assert {r.path: (r.entropy, r.entropy_risk) for r in metrics.entropy(rows, "path").collect()} == {"p": (0.0, 0.0), "q": (1.0, 1.0)}


def test_visible_ancestors_stop_at_missing_parents(spark):
    rows = spark.createDataFrame([("r", None, 1), ("d", "r", 2), ("f", "d", 6), ("lost", "gone", 6)], "id string, parent_id string, canonical_rank int")
    got = {r.id: (r.ancestor, r.hops) for r in visual.visible_ancestors(rows, (1, 2)).collect()}
    assert got == {"r": ("r", 0), "d": ("d", 0), "f": ("d", 1), "lost": (None, None)}


def test_policy_rule_types(spark):
    n = nodes(spark, [("x::a", "STRUCTURE", "class", "x"), ("x::b", "STRUCTURE", "class", "x")]).withColumn("is_exported", F.col("id") == "x::a").withColumn("frameworks", F.array(F.lit("flask")))
    e = edges(spark, [("x::a", "lib::base", "EXTENDS"), ("x::b", "x::a", "CALLS")])
    rules = [
        {"id": "h", "type": "require_heritage", "target": "Base"}, {"id": "e", "type": "require_export"}, {"id": "c", "type": "require_caller", "target": "b"},
        {"id": "w", "type": "framework_check", "target": "django"}, {"id": "f", "type": "require_file", "target": "y"}, {"id": "m", "type": "max_fans", "max": 0 or 1},
    ]
    got = {(r.rule_id, r.node_id) for r in governance.policy_violations(n, e, rules).collect()}
    assert got == {("h", "x::b"), ("e", "x::b"), ("c", "x::b"), ("w", "x::a"), ("w", "x::b"), ("f", "global")}
    assert governance.framework_coverage(n).first().asDict() == {"framework": "flask", "n": 2}
    with pytest.raises(ValueError):
        governance.policy_violations(n, e, [{"id": "?", "type": "?"}])


def test_diagnostics_on_an_empty_graph(spark):
    n, e = nodes(spark, [("a", "UNIT", "unit", "f")]), edges(spark, [("a", "b", "CALLS")])
    assert {(r.id, r.side) for r in diagnostics.dangling_edges(n.where("false"), e).collect()} == {("CALLS::a->b::0", "source"), ("CALLS::a->b::0", "target")}
    assert diagnostics.layer_census(n.where("false"), e).count() == 0
    assert [r.id for r in diagnostics.units_outside(n, e).collect()] == ["a"]


def test_bare_targets_need_an_import(spark):
    n = spark.createDataFrame([("a::unit", "a", "a::unit", 0.0), ("a::f", "f", "a::unit", 0.0), ("b::g", "g", "b::unit", 0.0)], "id string, name string, unit_id string, gravity double")
    e = edges(spark, [("a::f", "g", "CALLS")])
    assert linking.resolve_bare_targets(n, e).count() == 0
    more = e.unionByName(edges(spark, [("a::unit", "b::unit", "IMPORTS")]).withColumn("id", F.lit("imp")))
    assert [r.new_target_id for r in linking.resolve_bare_targets(n, more).collect()] == ["b::g"]


def test_strong_components_however_they_are_found(spark):
    """Searched in tasks and coloured in rounds, against reachability in both directions."""
    r = random.Random(5)
    for n, m in ((6, 9), (40, 55), (12, 60)):
        pairs = {(f"{r.randrange(3)}:{r.randrange(n)}",) * 1 + (f"{r.randrange(3)}:{r.randrange(n)}",) for _ in range(m)}
        df = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "source_id string, target_id string, type string")
        ids = {x for p in pairs for x in p}
        reach = {x: {x} for x in ids}
        for _ in ids:
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {}
        for x in ids:
            own = {y for y in reach[x] if x in reach[y]}
            if len(own) > 1 or (x, x) in pairs:
                want[x] = (max(own), len(own))
        for most in (1_000_000, 1):
            assert {q.id: (q.component, q.size) for q in G.strong_components(df, most=most).collect()} == want, (n, m, most)


def test_nearest_ancestor_over_long_ways_rings_and_gaps(spark):
    rows = [(f"n{i}", f"n{i + 1}" if i < 40 else None, i == 40 or i == 7) for i in range(41)] + [("r1", "r2", False), ("r2", "r1", False), ("g", "gone", False), ("self", "self", False), ("top", None, True)]
    df = spark.createDataFrame(rows, "id string, parent_id string, ok boolean")
    up = {i: (p, ok) for i, p, ok in rows}

    def walk(i, include_self, most):
        at, hops = i, 0
        while at in up and hops <= most:
            if up[at][1] and (hops or include_self):
                return at, hops
            at, hops = up[at][0], hops + 1
        return None, None

    for include_self in (True, False):
        for most in (1, 5, 20):
            got = {q.id: (q.ancestor, q.hops) for q in G.nearest_ancestor(df, F.col("ok"), most, include_self).collect()}
            assert got == {i: walk(i, include_self, most) for i in up}, (include_self, most)


def test_pagerank_against_power_iteration(spark):
    r = random.Random(3)
    ids = [f"v{i}" for i in range(30)]
    pairs = [(r.choice(ids[:25]), r.choice(ids)) for _ in range(60)]
    nodes = spark.createDataFrame([(i, "BEHAVIOR", "function") for i in ids] + [("atom", "ATOM", "variable")], "id string, canonical_kind string, semantic_kind string")
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "source_id string, target_id string, type string")
    got = {q.id: q.rank for q in G.pagerank(nodes, edges).collect()}
    own = [i for i in ids if got[i] > 0]
    rank = dict.fromkeys(own, 1 / len(own))
    out = {a: [b for x, b in pairs if x == a] for a in own}
    for _ in range(30):
        lost = sum(v for a, v in rank.items() if not out[a])
        new = dict.fromkeys(own, 0.15 / len(own) + 0.85 * lost / len(own))
        for a, v in rank.items():
            for b in out[a]:
                new[b] += 0.85 * v / len(out[a])
        rank = new
    assert len(own) == 30 and got["atom"] == 0 and all(abs(got[a] - rank[a]) < 1e-12 for a in own)
