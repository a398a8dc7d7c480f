"""The graph as it is drawn: visible ancestors, clusters, orbits, promoted links."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees, nearest_ancestor
from .search import first

ALL_LAYERS = tuple(range(9))


def _rank():
    return F.coalesce("canonical_rank", F.lit(4))


def visible_ancestors(nodes: DataFrame, layers: Sequence[int]) -> DataFrame:
    """GR-31: (id, ancestor, hops): the nearest node on the way up, itself included, whose layer is visible."""
    return nearest_ancestor(nodes, _rank().isin(*layers))


def clusters_of(nodes: DataFrame) -> DataFrame:
    """GR-32: (id, cluster): the first directory, repository or namespace on the way up, else ``ecosystem::global``."""
    found = nearest_ancestor(nodes, F.col("canonical_kind").isin("DIRECTORY", "REPOSITORY", "NAMESPACE"), 20)
    return found.select("id", F.coalesce("ancestor", F.lit("ecosystem::global")).alias("cluster"))


def promoted_links(nodes: DataFrame, edges: DataFrame, layers: Sequence[int] = ALL_LAYERS) -> DataFrame:
    """VIS-02: (source, target, category, type, weight, confidence, transitive_depth): edges lifted to visible ancestors.

    Loops and links lifted more than five hops go; of several with the same ends and category the first by edge id stays.
    """
    up = visible_ancestors(nodes, layers).where("ancestor IS NOT NULL")
    lifted = edges.join(up.select(F.col("id").alias("source_id"), F.col("ancestor").alias("source"), F.col("hops").alias("h1")), "source_id").join(up.select(F.col("id").alias("target_id"), F.col("ancestor").alias("target"), F.col("hops").alias("h2")), "target_id")
    depth = F.col("h1") + F.col("h2")
    category = F.when(F.col("type").isin("MEMBER_OF", "CONTAINS"), "LINEAGE").otherwise("KINESIS")
    kept = lifted.where((F.col("source") != F.col("target")) & (depth <= 5)).select("id", "source", "target", category.alias("category"), "type", depth.alias("transitive_depth"), F.coalesce("confidence", F.lit(1.0)).alias("c") if "confidence" in edges.columns else F.lit(1.0).alias("c"))
    best = first(kept, ["source", "target", "category"], "id")
    weight = F.greatest(F.lit(0.1), 1.0 - F.col("transitive_depth") * 0.15)
    return best.select("source", "target", "category", "type", F.round(weight, 6).alias("weight"), F.round(F.col("c") * weight, 6).alias("confidence"), "transitive_depth")


def placed_nodes(nodes: DataFrame, edges: DataFrame, layers: Sequence[int] = ALL_LAYERS, spread: float = 1200.0) -> DataFrame:
    """VIS-01, WIN-03, WIN-04, SRT-07: (id, cluster, level, degree, mass, orbit, x, y, cluster_size) of visible nodes.

    Within a cluster nodes stand in orbits in the order (layer, degree down, id). Cluster centres: those without a
    parent, or under an ecosystem, on a ring in the order of their ids; others in a grid of ten below the ring's middle,
    also in the order of their ids.
    """
    folders = nodes.where(F.col("canonical_kind").isin("NAMESPACE", "DIRECTORY", "REPOSITORY")).select("id", "parent_id")
    top = F.coalesce(F.col("parent_id").startswith("ecosystem"), F.lit(True))
    by = Window.partitionBy("top").orderBy("id")  # folders: few beside the nodes
    ring = folders.select("id", top.alias("top")).withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("top")))
    angle = F.col("i") * (2 * math.pi) / F.col("n")
    centre = ring.select(F.col("id").alias("cluster"), F.when(F.col("top"), spread * 0.8 * F.cos(angle)).otherwise((F.col("i") % 10 - 5) * 120.0).alias("cx"), F.when(F.col("top"), spread * 0.8 * F.sin(angle)).otherwise(180.0).alias("cy"))
    own = nodes.where(_rank().isin(*layers)).select("id", _rank().alias("level"))
    joined = own.join(clusters_of(nodes), "id").join(degrees(edges).select("id", "degree"), "id", "left").fillna({"degree": 0})
    within = Window.partitionBy("cluster").orderBy("level", F.col("degree").desc(), "id")
    ranked = joined.withColumn("i", F.row_number().over(within) - 1).withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("cluster")))
    orbit = F.floor(F.sqrt(F.col("i") + 1))
    slots = orbit * 2 + 1
    turn = (F.col("i") % slots) / slots * (2 * math.pi)
    out = ranked.join(centre, "cluster", "left").fillna(0.0, ["cx", "cy"])
    return out.select("id", "cluster", "level", "degree", (1 + F.col("degree") / 10).alias("mass"), orbit.cast("int").alias("orbit"), F.round(F.col("cx") + orbit * 60 * F.cos(turn), 3).alias("x"), F.round(F.col("cy") + orbit * 60 * F.sin(turn), 3).alias("y"), "cluster_size")


def mermaid(nodes: DataFrame, edges: DataFrame, limit: int = 30) -> str:
    """SNK-12: a diagram of the ``limit`` heaviest nodes and their neighbours (a report of bounded size)."""
    top = nodes.orderBy(F.col("gravity").desc_nulls_last(), "id").limit(limit).select("id")
    near = edges.join(top.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(edges.join(top.select(F.col("id").alias("target_id")), "target_id", "left_semi"))
    rows = near.select("source_id", "target_id", "type").distinct().orderBy("source_id", "target_id", "type").limit(20 * limit).collect()
    name = lambda x: '"' + x.replace('"', "'") + '"'
    return "\n".join(["graph TD", *(f"  {name(r[0])} -->|{r[2]}| {name(r[1])}" for r in rows)])
