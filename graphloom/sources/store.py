"""The graph store: nodes and edges as Parquet partitioned by snapshot, with complete snapshots and pruned reads.

A store is a folder with ``nodes``, ``edges``, ``snapshots`` and ``meta``. Writes replace whole snapshot partitions
(dynamic overwrite), so a task that runs twice or an attempt that fails leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import first
from ..schema import EDGES, NODES, SNAPSHOTS, normal_edges, normal_nodes


def carry_forward(old: DataFrame, new: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """SNK-01, SNK-02: a complete next snapshot: what is new, and of the old all whose unit wasn't analysed again.

    units: (unit_id). Rows of the old snapshot take the new one's id from ``new`` later, by the caller.
    """
    kept = old.join(units.select(F.col("unit_id").alias(key)), key, "left_anti").join(new.select("id"), "id", "left_anti")
    return new.unionByName(kept.select(*new.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("snapshot_id", "id")) -> DataFrame:
    """SET-07: rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*new.columns).unionByName(new)


def purge_units(nodes: DataFrame, edges: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-03: nodes and edges without the units' nodes and the edges out of them; the doomed ids are found first."""
    doomed = nodes.join(units.select("unit_id"), "unit_id", "left_semi").select("id")
    return nodes.join(doomed, "id", "left_anti"), edges.join(doomed.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def clear_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """GR-20: without a file's nodes and every edge at one of them."""
    gone = nodes.where(F.lower("file") == file.lower()).select("id")
    left = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return nodes.where(F.lower("file") != file.lower()), left


def federate(parts: Sequence[DataFrame], keys: Sequence[str] = ("id",)) -> DataFrame:
    """SRC-24, SET-03: the union of stores; of one key in several the later store's row stays."""
    numbered = [p.withColumn("__gl_store", F.lit(i)) for i, p in enumerate(parts)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return first(whole, list(keys), F.col("__gl_store").desc()).drop("__gl_store")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def nodes(self, snapshot: str | None = None) -> DataFrame:
        """SRC-20, SRC-23."""
        df = self._read("nodes", NODES)
        return df if snapshot is None else df.where(F.col("snapshot_id") == snapshot)

    def edges(self, snapshot: str | None = None) -> DataFrame:
        df = self._read("edges", EDGES)
        return df if snapshot is None else df.where(F.col("snapshot_id") == snapshot)

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOTS)

    def latest(self) -> str | None:
        row = self.snapshots().orderBy(F.col("ts").desc(), F.col("id").desc()).first()
        return row["id"] if row else None

    def as_of(self, ts: int) -> str | None:
        """The last snapshot at or before a time."""
        row = self.snapshots().where(F.col("ts") <= ts).orderBy(F.col("ts").desc(), F.col("id").desc()).first()
        return row["id"] if row else None

    def node(self, node_id: str, snapshot: str | None = None) -> DataFrame:
        """SRC-21."""
        return self.nodes(snapshot).where(F.col("id") == node_id.lower())

    def sql(self, text: str, **parameters) -> DataFrame:
        """SRC-22: a statement over {nodes}, {edges} and {snapshots} with named parameters (``:name``)."""
        return self.spark.sql(text, args=parameters or None, nodes=self.nodes(), edges=self.edges(), snapshots=self.snapshots())

    def write(self, snapshot: str, ts: int, nodes: DataFrame, edges: DataFrame, replaces: DataFrame | None = None, commit_hash: str | None = None, metadata: str = "{}") -> None:
        """SNK-01, SNK-02, SNK-04: a complete snapshot. replaces: (unit_id) analysed anew: all else of the last snapshot is carried forward; None: nothing is."""
        new_nodes, new_edges = normal_nodes(nodes.withColumn("snapshot_id", F.lit(snapshot))), normal_edges(edges.withColumn("snapshot_id", F.lit(snapshot)))
        last = self.latest()
        if replaces is not None and last is not None and last != snapshot:
            old_nodes, old_edges = purge_units(self.nodes(last), self.edges(last), replaces)
            stamp = lambda df: df.withColumn("snapshot_id", F.lit(snapshot))
            new_nodes, new_edges = upsert(stamp(old_nodes), new_nodes), upsert(stamp(old_edges), new_edges)
        for name, df in (("nodes", new_nodes), ("edges", new_edges)):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{self.path}/{name}")
        counts = [d.count() for d in (self.nodes(snapshot), self.edges(snapshot))]
        header = self.spark.createDataFrame([(snapshot, ts, commit_hash, counts[0], counts[1], metadata)], SNAPSHOTS)
        header.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").parquet(f"{self.path}/snapshots")

    def clear(self) -> None:
        """SNK-07."""
        jvm = self.spark.sparkContext._jvm
        for name in ("nodes", "edges", "snapshots"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
