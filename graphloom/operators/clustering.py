"""Agglomerative clustering of files by links and folders (GR-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import path_proximity
from ..plans.loops import written


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): unordered pairs of files with an edge between them."""
    own = nodes.where("file IS NOT NULL").select("id", "file")
    linked = edges.join(own.select(F.col("id").alias("source_id"), F.col("file").alias("x")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("file").alias("y")), "target_id").where("x <> y")
    return linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def cluster_files(nodes: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """GR-24, GR-25: (file, cluster): average linkage, the best pair of clusters first, while its affinity is above the threshold.

    Affinity of two clusters = 0.6 x share of linked file pairs + 0.4 x mean path proximity. Pairs of clusters are kept as
    sums over file pairs, so a merge adds rows instead of comparing files again. A pair can only pass 0.5 with a link (0.4
    is the most that proximity gives), and links of clusters come from links of files, so pairs without any link are never
    made; the proximity of linked clusters is summed over their members when they first meet. Every step merges all pairs
    that are each other's best (ties: the smaller names), which are the merges that one at a time would reach.
    """
    if threshold < 0.4:
        raise ValueError("thresholds below 0.4 would need pairs of files without links")
    member = written(nodes.where("file IS NOT NULL").select("file").distinct().withColumn("cluster", F.col("file")))
    links = written(file_links(nodes, edges))
    while True:
        sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        lifted = links.join(member.select(F.col("file").alias("a"), F.col("cluster").alias("ca")), "a").join(member.select(F.col("file").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb")
        pairs = lifted.groupBy(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q")).agg(F.count(F.lit(1)).alias("linked"))
        pairs = pairs.join(sizes.select(F.col("cluster").alias("p"), F.col("n").alias("np")), "p").join(sizes.select(F.col("cluster").alias("q"), F.col("n").alias("nq")), "q")
        # proximity is at most 1, so a pair that can't pass even then needs no members
        possible = pairs.where(0.6 * F.col("linked") / (F.col("np") * F.col("nq")) + 0.4 > threshold)
        spread = possible.join(member.select(F.col("cluster").alias("p"), F.col("file").alias("f")), "p").join(member.select(F.col("cluster").alias("q"), F.col("file").alias("g")), "q")
        scored = spread.groupBy("p", "q", "linked", "np", "nq").agg(F.avg(path_proximity(F.col("f"), F.col("g"))).alias("near"))
        affinity = F.round(0.6 * F.col("linked") / (F.col("np") * F.col("nq")) + 0.4 * F.col("near"), 9)
        scored = written(scored.select("p", "q", affinity.alias("affinity")).where(F.col("affinity") > threshold))
        if scored.isEmpty():
            return member
        both = scored.select(F.col("p").alias("c"), "affinity", "p", "q").unionByName(scored.select(F.col("q").alias("c"), "affinity", "p", "q"))
        best = both.groupBy("c").agg(F.min(F.struct((-F.col("affinity")).alias("x"), "p", "q")).alias("b")).select("c", "b.p", "b.q")
        mutual = best.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("q").alias("cluster"), F.col("p").alias("into"))
        member = written(member.join(mutual, "cluster", "left").select("file", F.coalesce("into", "cluster").alias("cluster")))
