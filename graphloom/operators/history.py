"""Operators over snapshots: diff, drift, moves, trend, regression guard, co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import written
from . import pairs


def at(df: DataFrame, snapshot: str) -> DataFrame:
    """SRC-23: a snapshot's rows; the filter prunes the store's partitions."""
    return df.where(F.col("snapshot_id") == snapshot)


def latest(snapshots: DataFrame, n: int = 1) -> DataFrame:
    """SRT-05: the last n snapshots, newest first."""
    return snapshots.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def node_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """GR-23, JN-20: (id, change): added or removed nodes."""
    added = head.select("id").join(base.select("id"), "id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(base.select("id").join(head.select("id"), "id", "left_anti").withColumn("change", F.lit("removed")))


def edge_changes(base_nodes: DataFrame, base: DataFrame, head_nodes: DataFrame, head: DataFrame) -> DataFrame:
    """GR-23: (id, change): edges that left existing nodes and are new or gone."""
    a, b = base.join(base_nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id"), head.join(head_nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id")
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "id", "left_anti").withColumn("change", F.lit("removed")))


def property_drift(base: DataFrame, head: DataFrame, threshold: float = 0.01) -> DataFrame:
    """GR-23: nodes of both whose gravity shifted, complexity or churn changed; what didn't is null."""
    old = base.select("id", F.col("gravity").alias("g"), F.col("complexity").alias("c"), F.col("churn").alias("h"))
    joined = head.select("id", "gravity", "complexity", "churn").join(old, "id")
    shift = F.round(F.coalesce("gravity", F.lit(0.0)) - F.coalesce("g", F.lit(0.0)), 6)
    bloat, churn = (F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)) for x, y in (("complexity", "c"), ("churn", "h")))
    out = joined.select("id", F.when(F.abs(shift) > threshold, shift).alias("gravity_shift"), F.when(bloat != 0, bloat).alias("complexity_bloat"), F.when(churn != 0, churn).alias("churn_drift"))
    return out.where("gravity_shift IS NOT NULL OR complexity_bloat IS NOT NULL OR churn_drift IS NOT NULL")


def diff(base_nodes: DataFrame, base_edges: DataFrame, head_nodes: DataFrame, head_edges: DataFrame) -> DataFrame:
    """GR-23: one row of counts and a summary."""
    n = node_changes(base_nodes, head_nodes).agg(F.count_if(F.col("change") == "added").alias("nodes_added"), F.count_if(F.col("change") == "removed").alias("nodes_removed"))
    e = edge_changes(base_nodes, base_edges, head_nodes, head_edges).agg(F.count_if(F.col("change") == "added").alias("edges_added"), F.count_if(F.col("change") == "removed").alias("edges_removed"))
    d = property_drift(base_nodes, head_nodes).agg(F.count(F.lit(1)).alias("drifted"))
    text = F.format_string("Delta: +%d/-%d Symbols, +%d/-%d Relationships.", "nodes_added", "nodes_removed", "edges_added", "edges_removed")
    none = F.col("nodes_added") + F.col("nodes_removed") + F.col("edges_added") + F.col("edges_removed") == 0
    summary = F.when(F.col("drifted") > 0, F.concat(text, F.format_string(" %d symbols showed structural drift.", "drifted"))).when(none, "No structural changes.").otherwise(text)
    return n.crossJoin(e).crossJoin(d).withColumn("summary", summary)  # rows of one each


def drift(base: DataFrame, head: DataFrame) -> DataFrame:
    """GOV-11, JN-05: nodes of both snapshots that moved: velocity = half of each delta, or another fingerprint."""
    old = base.select("id", F.col("gravity").alias("g"), F.col("complexity").alias("c"), F.col("fingerprint").alias("f"))
    joined = head.select("id", "name", "file", "gravity", "complexity", "fingerprint").join(old, "id")
    dg, dc = F.col("gravity") - F.col("g"), F.col("complexity") - F.col("c")
    velocity = F.round(dg * 0.5 + dc * 0.5, 9)
    out = joined.select("id", "name", "file", F.round(dg, 6).alias("gravity_delta"), dc.alias("complexity_delta"), (~F.col("fingerprint").eqNullSafe(F.col("f"))).alias("is_modified"), velocity.alias("velocity"))
    return out.where((F.abs("velocity") > 0.001) | F.col("is_modified"))


def moves(base: DataFrame, head: DataFrame) -> DataFrame:
    """GOV-11: nodes that are new under their id but whose fingerprint another id had."""
    new = head.join(base.select("id"), "id", "left_anti")
    old = base.select(F.col("id").alias("from_id"), "fingerprint")
    return new.join(old, "fingerprint").where("id <> from_id").select("from_id", F.col("id").alias("to_id"), "name", "file", "gravity")


def drift_summary(base: DataFrame, head: DataFrame) -> DataFrame:
    """GOV-11: one row: status, symbols, decaying, improving, moved."""
    common = head.select("id").join(base.select("id"), "id").agg(F.count(F.lit(1)).alias("total_symbols"))
    d = drift(base, head).agg(F.count_if(F.col("velocity") > 0).alias("decay_count"), F.count_if(F.col("velocity") < 0).alias("improvement_count"), F.coalesce(F.max("velocity"), F.lit(0.0)).alias("most"))
    m = moves(base, head).agg(F.count(F.lit(1)).alias("move_count"))
    return common.crossJoin(d).crossJoin(m).select(F.when(F.col("most") > 0.05, "DECAYING").otherwise("STABLE").alias("status"), "total_symbols", "decay_count", "improvement_count", "move_count")


def guard(base: DataFrame, head: DataFrame, threshold: float = 0.1) -> DataFrame:
    """GOV-10, AGG-18: one row: whether the mean velocity blocks, and the factors."""
    d = drift(base, head).agg(
        F.coalesce(F.avg("velocity"), F.lit(0.0)).alias("risk"), F.coalesce(F.sum("velocity"), F.lit(0.0)).alias("total"), F.count_if(F.col("velocity") > threshold * 1.5).alias("high"),
        F.coalesce(F.bool_or(F.col("complexity_delta") > 10), F.lit(False)).alias("bloat"), F.coalesce(F.max("velocity"), F.lit(0.0)).alias("most"),
    )
    both = d.crossJoin(moves(base, head).agg(F.count(F.lit(1)).alias("moved")))
    decaying = F.col("most") > 0.05
    named = ((F.col("high") > 0, "critical_velocity"), (F.col("bloat"), "complexity_bloat"), (F.col("total") > threshold * 5, "footprint_expansion"), (F.col("moved") > 0, "renames"))
    factors = F.array_join(F.array_compact(F.array(*(F.when(decaying & c, F.lit(n)) for c, n in named))), ",")
    return both.select((decaying & (F.col("risk") > threshold)).alias("block"), F.round(F.when(decaying, F.col("risk")).otherwise(0.0), 6).alias("risk"), factors.alias("factors"))


def trend(nodes: DataFrame, snapshots: DataFrame, window: int = 5, limit: int = 20) -> DataFrame:
    """GOV-12, WIN-01, WIN-02: symbols whose mean change over the last snapshots is above 0.05, fastest first."""
    recent = F.broadcast(latest(snapshots, window).select(F.col("id").alias("snapshot_id"), "ts"))  # ``window`` rows
    by = Window.partitionBy("id").orderBy("ts")
    history = nodes.join(recent, "snapshot_id").select("id", "name", "file", "gravity", "complexity", F.lag("gravity").over(by).alias("g"), F.lag("complexity").over(by).alias("c"))
    rolled = history.where("g IS NOT NULL").groupBy("id", "name", "file").agg(F.avg(F.col("gravity") - F.col("g")).alias("dg"), F.avg(F.col("complexity") - F.col("c")).alias("dc"), F.count(F.lit(1)).alias("data_points"))
    velocity = F.round(0.6 * F.col("dg") + 0.4 * F.col("dc"), 6)
    out = rolled.select("id", "name", "file", velocity.alias("avg_velocity"), F.when(velocity > 0.1, "ACCELERATING").otherwise("STABLE").alias("trend"), "data_points")
    return out.where("avg_velocity > 0.05").orderBy(F.col("avg_velocity").desc(), "id").limit(limit)


def cochange(commits: DataFrame, min_count: int = 3, limit: int | None = 100) -> DataFrame:
    """JN-16, AGG-05: (file_a, file_b, n): pairs of paths in more than min_count commits together, most frequent first."""
    return pairs.shared(commits, "hash", "path", min_count + 1, limit).select(F.col("a").alias("file_a"), F.col("b").alias("file_b"), "n")


def hidden_coupling(commits: DataFrame, nodes: DataFrame, edges: DataFrame, min_count: int = 3, limit: int = 100) -> DataFrame:
    """GOV-15, JN-17: co-changing pairs without an edge between their files either way."""
    found = written(cochange(commits, min_count, limit), "cochange")  # read three times
    files = found.select(F.col("file_a").alias("file")).union(found.select(F.col("file_b").alias("file"))).distinct()
    own = written(nodes.join(files, "file", "left_semi").select("id", "file"), "cochange-nodes")  # other nodes link no such pair
    source, target = (own.select(F.col("id").alias(i), F.col("file").alias(f)) for i, f in (("source_id", "x"), ("target_id", "y")))
    near = edges.join(source, "source_id", "left_semi").select("source_id", "target_id")  # Spark filters before edges are summed up
    linked = near.join(source, "source_id").join(target, "target_id").where("x <> y")
    linked = linked.select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b")).distinct()
    return found.join(linked, ["file_a", "file_b"], "left_anti").select("file_a", "file_b", F.least(F.col("n") / 10, F.lit(1.0)).alias("confidence"))


def previous_risk(nodes: DataFrame, snapshots: DataFrame, symbol: str) -> DataFrame:
    """SRT-04: a symbol's risk in the snapshot before the last one that has it."""
    own = nodes.where(F.col("id") == symbol).join(F.broadcast(snapshots.select(F.col("id").alias("snapshot_id"), "ts")), "snapshot_id")  # a symbol's history
    return own.orderBy(F.col("ts").desc()).offset(1).limit(1).select("snapshot_id", "risk")
