"""The library of named, parameterised questions (T-01 to T-20).

Each takes the nodes and edges of a store and a snapshot id and returns a DataFrame. Limits order by the documented keys
and then by id, so results are deterministic. The snapshot filter sits on both inputs, where it prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 10
CODE = ("BEHAVIOR", "STRUCTURE")


def _at(df: DataFrame, snapshot: str) -> DataFrame:
    return df.where(F.col("snapshot_id") == snapshot)


def _top(df: DataFrame, *order: Column, limit: int | None = LIMIT, tie: str = "id") -> DataFrame:
    out = df.orderBy(*order, F.col(tie).asc_nulls_last())
    return out if limit is None else out.limit(limit)


def _down(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def _like(column: str, pattern: str | None) -> Column:
    return F.lit(True) if not pattern else F.col(column).like(pattern)


def _sources(nodes: DataFrame, edges: DataFrame, snapshot: str, target: str, edge_type: str | None, *columns: str) -> DataFrame:
    """The nodes at the sources of a symbol's incoming edges, one row an edge."""
    into = _at(edges, snapshot).where(F.col("target_id") == target)
    if edge_type is not None:
        into = into.where(F.col("type") == edge_type)
    into = into.select(F.col("source_id").alias("id"), *(c for c in ("weight", "type") if c in columns))
    own = _at(nodes, snapshot).select("id", *(c for c in columns if c not in ("weight", "type")))
    return into.join(own, "id").select("id", *columns)


def find_usages(nodes, edges, snapshot, symbol, edge_type="CALLS", limit=LIMIT):
    """T-01: who uses a symbol by edges of one type, riskiest first."""
    return _top(_sources(nodes, edges, snapshot, symbol, edge_type, "name", "file", "structure_id", "namespace_id", "risk", "canonical_kind", "canonical_rank"), _down("risk"), limit=limit)


def find_imports(nodes, edges, snapshot, target, limit=LIMIT):
    """T-02: who imports a target, heaviest first."""
    return _top(_sources(nodes, edges, snapshot, target, "IMPORTS", "name", "file", "namespace_id", "risk", "gravity", "canonical_kind", "canonical_rank"), _down("gravity"), limit=limit)


def _untouched(nodes, edges, snapshot, edge_type=None):
    into = _at(edges, snapshot)
    if edge_type is not None:
        into = into.where(F.col("type") == edge_type)
    return _at(nodes, snapshot).join(into.select(F.col("target_id").alias("id")), "id", "left_anti")


def unused_exports(nodes, edges, snapshot, limit=LIMIT):
    """T-03: exported code that nothing imports."""
    own = nodes.where(F.col("is_exported") & F.col("canonical_kind").isin(*CODE))
    return _top(_untouched(own, edges, snapshot, "IMPORTS").select("id", "name", "file", "risk", "tenure_days", "canonical_kind", "canonical_rank"), _down("risk"), limit=limit)


def dead_code(nodes, edges, snapshot, min_tenure_days=0, limit=LIMIT):
    """T-04: code without any incoming edge that is no entry point."""
    own = nodes.where(~F.col("is_entry_point") & F.col("canonical_kind").isin(*CODE) & (F.col("tenure_days") >= min_tenure_days))
    found = _untouched(own, edges, snapshot).select("id", "name", "file", "risk", "gravity", "complexity", "canonical_kind", "semantic_kind", "structure_id", "tenure_days", "primary_author")
    return _top(found, _down("risk"), _down("tenure_days"), limit=limit)


def high_risk_dead_code(nodes, edges, snapshot, min_complexity=1, min_tenure_days=0, limit=LIMIT):
    """T-05: the same for any kind, if it is complex."""
    own = nodes.where(~F.col("is_entry_point") & (F.col("complexity") >= min_complexity) & (F.col("tenure_days") >= min_tenure_days))
    return _top(_untouched(own, edges, snapshot).select("id", "name", "file", "risk", "complexity", "tenure_days", "primary_author"), _down("risk"), limit=limit)


def blast_radius(nodes, edges, snapshot, symbol, limit=LIMIT):
    """T-06: direct dependents, heaviest edge first."""
    found = _sources(nodes, edges, snapshot, symbol, None, "name", "file", "risk", "structure_id", "namespace_id", "weight", "type", "canonical_kind", "canonical_rank")
    return _top(found, _down("weight"), _down("risk"), F.col("id"), limit=limit, tie="type")


def deep_impact(nodes, edges, snapshot, symbol, max_depth=5, limit=LIMIT):
    """T-07: transitive dependents with their least distance.

    The frontier is deduplicated at every step, so the work follows the edges reached, not the number of paths.
    """
    from .graph import bfs

    reached = bfs(_at(edges, snapshot), symbol, "upstream", max_depth, include_start=None)
    found = reached.join(_at(nodes, snapshot).select("id", "name", "file", "risk", "canonical_kind", "namespace_id"), "id")
    return _top(found.select("id", "name", "file", "risk", "canonical_kind", "namespace_id", F.col("depth").alias("hop_distance")), F.col("hop_distance").asc(), _down("risk"), limit=limit)


def structural_siblings(nodes, edges, snapshot, symbol):
    """T-08: the other members of a symbol's structure."""
    own = _at(nodes, snapshot)
    of = own.where(F.col("id") == symbol).select("structure_id").where("structure_id IS NOT NULL")
    found = own.join(F.broadcast(of), "structure_id", "left_semi").where(F.col("id") != symbol)  # one row: ids are unique in a snapshot
    return _top(found.select("id", "name", "risk", "complexity", "gravity", "semantic_kind", "visibility", "canonical_kind", "canonical_rank"), _down("risk"), limit=None)


def symbols_in_structure(nodes, edges, snapshot, structure):
    """T-09: a structure's members."""
    found = _at(nodes, snapshot).where(F.col("structure_id") == structure)
    return _top(found.select("id", "name", "semantic_kind", "risk", "gravity", "complexity", "visibility", "is_entry_point", "canonical_kind", "canonical_rank", "is_async", "is_static", "returns"), _down("gravity"), limit=None)


def symbols_in_namespace(nodes, edges, snapshot, pattern, kind=None, limit=LIMIT):
    """T-10: members of namespaces that are LIKE a pattern."""
    found = _at(nodes, snapshot).where(_like("namespace_id", pattern))
    if kind:
        found = found.where(F.col("canonical_kind") == kind)
    return _top(found.select("id", "name", "file", "canonical_kind", "semantic_kind", "risk", "gravity", "complexity", "structure_id", "canonical_rank"), _down("gravity"), limit=limit)


def full_ancestry(nodes, edges, snapshot, symbol):
    """T-11: a symbol with the names of its parent, file, namespace and class."""
    own = _at(nodes, snapshot)
    out = own.where(F.col("id") == symbol)
    for pointer, name in (("parent_id", "parent_name"), ("unit_id", "file_name"), ("namespace_id", "namespace_name"), ("structure_id", "class_name")):
        out = out.join(own.select(F.col("id").alias(pointer), F.col("name").alias(name)), pointer, "left")
    return out.select("id", "name", "file", "canonical_kind", "risk", "parent_id", "unit_id", "namespace_id", "structure_id", "parent_name", "file_name", "namespace_name", "class_name")


def class_health_rollup(nodes, edges, snapshot, unit):
    """T-12: per structure of a file, over its behaviour."""
    found = _at(nodes, snapshot).where((F.col("unit_id") == unit) & (F.col("canonical_kind") == "BEHAVIOR"))
    rolled = found.groupBy("structure_id").agg(
        F.round(F.avg("risk"), 6).alias("class_risk"), F.sum("complexity").alias("total_complexity"), F.count(F.lit(1)).alias("method_count"),
        F.max("gravity").alias("peak_gravity"), F.min("risk").alias("lowest_method_risk"),
    )
    return _top(rolled, _down("class_risk"), limit=None, tie="structure_id")


def high_risk_symbols(nodes, edges, snapshot, min_risk=0.5, namespace=None, limit=LIMIT):
    """T-13: symbols above a risk."""
    found = _at(nodes, snapshot).where((F.col("risk") >= min_risk) & _like("namespace_id", namespace))
    return _top(found.select("id", "name", "file", "risk", "gravity", "complexity", "canonical_kind", "semantic_kind", "structure_id", "canonical_rank"), _down("risk"), limit=limit)


def hotspots(nodes, edges, snapshot, limit=LIMIT):
    """T-14: code by 0.6 risk + 0.4 gravity."""
    found = _at(nodes, snapshot).where(F.col("canonical_kind").isin(*CODE))
    score = F.round(F.col("risk") * 0.6 + F.col("gravity") * 0.4, 6).alias("hotspot_score")
    return _top(found.select("id", "name", "file", "risk", "gravity", "complexity", "canonical_kind", "semantic_kind", "structure_id", score, "churn", "primary_author"), _down("hotspot_score"), limit=limit)


def entry_points(nodes, edges, snapshot, limit=LIMIT):
    """T-15: entry points by gravity."""
    found = _at(nodes, snapshot).where("is_entry_point")
    return _top(found.select("id", "name", "file", "gravity", "risk", "complexity", "canonical_kind", "semantic_kind", "namespace_id"), _down("gravity"), limit=limit)


def find_by_name(nodes, edges, snapshot, query, namespace=None, kind=None, limit=LIMIT):
    """T-16: names that are or hold a text (case-sensitive), by gravity."""
    found = _at(nodes, snapshot).where(F.col("name").contains(query))
    if namespace:
        found = found.where(F.col("namespace_id").contains(namespace))
    if kind:
        found = found.where(F.col("canonical_kind") == kind)
    return _top(found.select("id", "name", "file", "risk", "gravity", "complexity", "canonical_kind", "semantic_kind", "structure_id", "namespace_id"), _down("gravity"), limit=limit)


def cross_namespace_coupling(nodes, edges, snapshot, limit=LIMIT):
    """T-17: pairs of namespaces by the number of edges between them."""
    own = _at(nodes, snapshot).where("namespace_id IS NOT NULL").select("id", "namespace_id", "risk")
    source = own.select(F.col("id").alias("source_id"), F.col("namespace_id").alias("from_namespace"), F.col("risk").alias("source_risk"))
    target = own.select(F.col("id").alias("target_id"), F.col("namespace_id").alias("to_namespace"))
    pairs = _at(edges, snapshot).select("source_id", "target_id", "weight").join(source, "source_id").join(target, "target_id").where("from_namespace <> to_namespace")
    rolled = pairs.groupBy("from_namespace", "to_namespace").agg(F.count(F.lit(1)).alias("edge_count"), F.round(F.avg("weight"), 6).alias("avg_coupling"), F.max("source_risk").alias("max_source_risk"))
    return _top(rolled, _down("edge_count"), F.col("from_namespace"), limit=limit, tie="to_namespace")


def cycles(nodes, edges, snapshot, limit=LIMIT):
    """T-18: nodes that are marked as part of a cycle (see governance.mark_cycles)."""
    found = _at(nodes, snapshot).where(F.col("anomaly") == "cycle")
    return _top(found.select("id", "name", "file", "risk", "namespace_id", "anomaly"), _down("risk"), limit=limit)


def layer_distribution(nodes, edges, snapshot):
    """T-19: what each layer holds."""
    rolled = _at(nodes, snapshot).groupBy("canonical_rank", "canonical_kind").agg(
        F.count(F.lit(1)).alias("symbol_count"), F.round(F.avg("risk"), 6).alias("avg_risk"), F.round(F.avg("gravity"), 6).alias("avg_gravity"), F.count_if("is_entry_point").alias("entry_point_count")
    )
    return _top(rolled, F.col("canonical_rank").asc_nulls_last(), limit=None, tie="canonical_kind")


def suspicious_fallbacks(nodes, edges, snapshot, min_confidence=0.5, min_tenure_days=0, limit=LIMIT):
    """T-20: code that the fallback detector flags (columns is_fallback, fallback_confidence, fallback_ratio, naming_score)."""
    found = _at(nodes, snapshot).where(F.col("is_fallback") & (F.col("fallback_confidence") >= min_confidence) & (F.col("tenure_days") >= min_tenure_days) & F.col("canonical_kind").isin(*CODE))
    return _top(found.select("id", "name", "file", "risk", "gravity", "complexity", "canonical_kind", "canonical_rank", "tenure_days", "fallback_confidence", "fallback_ratio", "naming_score"), _down("fallback_confidence"), _down("risk"), limit=limit)


TEMPLATES = {
    f.__name__: f
    for f in (
        find_usages, find_imports, unused_exports, dead_code, high_risk_dead_code, blast_radius, deep_impact, structural_siblings, symbols_in_structure,
        symbols_in_namespace, full_ancestry, class_health_rollup, high_risk_symbols, hotspots, entry_points, find_by_name, cross_namespace_coupling,
        cycles, layer_distribution, suspicious_fallbacks,
    )
}


def execute(name: str, nodes: DataFrame, edges: DataFrame, snapshot: str, **parameters) -> DataFrame:
    """A template by its name, with named parameters."""
    if name not in TEMPLATES:
        raise KeyError(f"unknown template {name!r}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name](nodes, edges, snapshot, **parameters)
