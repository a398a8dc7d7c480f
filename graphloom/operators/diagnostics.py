"""Checks of a store (DIA-01 to DIA-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURAL = ("MEMBER_OF", "CONTAINS")
# Edges that make a symbol part of the running whole.
FUNCTIONAL = ("CALLS", "USES", "IMPORTS", "IMPLEMENTS", "EXTENDS", "TYPE_REFERENCE", "CONSTRUCTS")
# Names that may occur often.
COMMON_NAMES = (
    "init", "execute", "executeUserEntryPoint", "CORRUPT_UNIT", "unknown", "constructor", "log", "trace", "fmt", "query", "calculateComplexity",
    "extractDebt", "analyze", "link", "process", "main", "resolveImport",
)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DIA-01: (id, side) of edges one of whose ends is missing."""
    known = nodes.select("id").distinct()
    parts = [edges.join(known.select(F.col("id").alias(c)), c, "left_anti").select("id", F.lit(side).alias("side")) for c, side in (("source_id", "source"), ("target_id", "target"))]
    return parts[0].unionByName(parts[1])


def _touched(edges: DataFrame) -> DataFrame:
    """Ids at either end of a functional edge."""
    return edges.where(F.col("type").isin(*FUNCTIONAL)).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def layer_census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DIA-02: per layer its nodes, those at no functional edge, and the percentage of the others."""
    joined = nodes.select("id", "canonical_kind", "canonical_rank").join(_touched(edges).withColumn("hit", F.lit(1)), "id", "left")
    rolled = joined.groupBy("canonical_kind", "canonical_rank").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNull()).alias("orphans"))
    return rolled.select("canonical_kind", "canonical_rank", "total", "orphans", F.round(100.0 * (F.col("total") - F.col("orphans")) / F.col("total"), 4).alias("health"))


def shadow_symbols(nodes: DataFrame, more_than: int = 5, stop: Sequence[str] = COMMON_NAMES, limit: int = 10) -> DataFrame:
    """DIA-03, AGG-08: names of structures and behaviour that occur too often, with their files."""
    own = nodes.where(F.col("canonical_kind").isin("STRUCTURE", "BEHAVIOR") & ~F.col("name").isin(*stop))
    rolled = own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("files")).where(F.col("n") > more_than)
    return rolled.orderBy(F.col("n").desc(), "name").limit(limit)


def orphan_list(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("BEHAVIOR", "STRUCTURE")) -> DataFrame:
    """DIA-04: code that no functional edge reaches or leaves."""
    return nodes.where(F.col("canonical_kind").isin(*kinds)).join(_touched(edges), "id", "left_anti").select("id", "name", "canonical_kind")


def broken_parents(nodes: DataFrame) -> DataFrame:
    """DIA-06, JN-23."""
    return nodes.where("parent_id IS NOT NULL").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def disconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DIA-07."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return nodes.join(ends, "id", "left_anti").select("id", "canonical_kind")


def id_collisions(nodes: DataFrame) -> DataFrame:
    """DIA-08, AGG-09: ids that occur more than once in a snapshot."""
    return nodes.groupBy("snapshot_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def layer_evolution(nodes: DataFrame, snapshots: DataFrame, last: int = 5) -> DataFrame:
    """DIA-09."""
    recent = F.broadcast(snapshots.orderBy(F.col("ts").desc()).limit(last).select(F.col("id").alias("snapshot_id"), "ts"))  # ``last`` rows
    return nodes.join(recent, "snapshot_id").groupBy("snapshot_id", "ts", "canonical_kind").agg(F.count(F.lit(1)).alias("n"))


def illegal_parents(nodes: DataFrame) -> DataFrame:
    """DIA-10: (id, fault): units in units, symbols straight under a unit's layer without a parent."""
    parent = nodes.select(F.col("id").alias("parent_id"), F.col("canonical_kind").alias("parent_kind"))
    joined = nodes.join(parent, "parent_id", "left")
    fault = (
        F.when((F.col("canonical_kind") == "UNIT") & (F.col("parent_kind") == "UNIT"), "unit_in_unit")
        .when((F.col("canonical_rank") >= 4) & F.col("parent_id").isNull(), "no_parent")
        .when((F.col("canonical_rank") < 3) & (F.col("parent_kind") == "UNIT"), "layer_in_unit")
    )
    return joined.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def stale_edges(edges: DataFrame, snapshot: str) -> DataFrame:
    """DIA-11: edges of other snapshots, counted."""
    return edges.where(F.col("snapshot_id") != snapshot).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))


def connectivity(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """DIA-12: functional edges into a symbol and the files that they come from."""
    into = edges.where((F.col("target_id") == symbol) & ~F.col("type").isin(*STRUCTURAL)).join(nodes.select(F.col("id").alias("source_id"), "file"), "source_id")
    return into.agg(F.count(F.lit(1)).alias("incoming"), F.countDistinct("file").alias("files"))


def coverage(nodes: DataFrame) -> DataFrame:
    """DIA-13: what is missing, per kind."""
    columns = [c for c in ("parent_id", "unit_id", "file", "fingerprint") if c in nodes.columns]
    return nodes.groupBy("canonical_kind").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns))


def orphans_by_kind(nodes: DataFrame) -> DataFrame:
    """DIA-14: nodes without a parent, per kind."""
    return nodes.where("parent_id IS NULL").groupBy("canonical_kind").agg(F.count(F.lit(1)).alias("n"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    """DIA-14, AGG-20."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def parse_artefacts(nodes: DataFrame) -> DataFrame:
    """DIA-15."""
    return nodes.where("name IS NULL OR name IN ('', 'unknown')").select("id", "name")


def units_outside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DIA-16: units that no containment edge places anywhere."""
    placed = edges.where("type = 'CONTAINS'").select(F.col("target_id").alias("id")).unionByName(edges.where("type = 'MEMBER_OF'").select(F.col("source_id").alias("id")))
    return nodes.where("canonical_kind = 'UNIT'").join(placed, "id", "left_anti").select("id")


def totals(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """AGG-21: one row of counts."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(nodes, "nodes").crossJoin(n(edges, "edges")).crossJoin(n(snapshots, "snapshots"))  # rows of one each
