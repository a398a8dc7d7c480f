"""Metrics over nodes and edges: risk, cohesion, ownership, fallbacks, similarity of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.risk import nz
from .graph import degrees


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(edges).select("id", "in_degree", "out_degree", "degree")
    return nodes.join(d, "id", "left").fillna({"in_degree": 0, "out_degree": 0, "degree": 0})


def risk_advisor(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-01: (id, name, the six parts, risk)."""
    debt = F.size(F.coalesce("debt_markers", F.array().cast("array<string>"))) if "debt_markers" in nodes.columns else F.lit(0)
    parts = risk.advisor_parts(nz("gravity"), nz("complexity", 1), F.col("out_degree"), debt, nz("churn"), nz("entropy"))
    total = sum(parts.values(), F.lit(0.0))
    return with_degrees(nodes, edges).select("id", "name", *(F.round(v, 9).alias(k) for k, v in parts.items()), F.round(total, 9).alias("risk"))


def risk_basic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-04: (id, risk, factors)."""
    signals = (nz("gravity"), nz("entropy"), nz("churn"), F.col("out_degree"))
    return with_degrees(nodes, edges).select("id", F.round(risk.basic(*signals), 9).alias("risk"), risk.basic_factors(*signals, nz("complexity", 1)).alias("factors"))


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, internal, total): out-edges of each node and those that stay in its file."""
    own = nodes.select("id", "file")
    joined = edges.join(own.select(F.col("id").alias("source_id"), F.col("file").alias("f")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("file").alias("g")), "target_id", "left")
    return joined.groupBy(F.col("source_id").alias("id")).agg(F.count_if(F.col("f") == F.col("g")).alias("internal"), F.count(F.lit(1)).alias("total"))


def split_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-05: (id, name, score, cohesion, coupling); a node without out-edges is wholly cohesive."""
    c = F.coalesce(F.try_divide(F.col("internal"), F.col("total")), F.lit(1.0))
    joined = nodes.join(cohesion(nodes, edges), "id", "left")
    return joined.select("id", "name", F.round(risk.split_score(nz("gravity"), nz("entropy"), nz("churn"), c), 9).alias("score"), F.round(c, 9).alias("cohesion"), F.round(1 - c, 9).alias("coupling"))


def entropy(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """AGG-10, MET-06: Shannon entropy of a distribution (by, n) per ``by``, its share of log2(number) and the number."""
    sums = counts.groupBy(by).agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log2(n)).alias("s"), F.count(F.lit(1)).alias("k"))
    value = F.greatest(F.lit(0.0), F.log2("total") - F.col("s") / F.col("total"))
    return sums.select(by, F.round(value, 6).alias("entropy"), F.round(F.when(F.col("k") > 1, value / F.log2("k")).otherwise(0.0), 6).alias("entropy_risk"), F.col("k").alias("authors"))


def churn(commits: DataFrame) -> DataFrame:
    """SRC-07: commits and distinct authors of each path."""
    return commits.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"))


def ownership(commits: DataFrame) -> DataFrame:
    """SRC-08: commits of each author on each path."""
    return commits.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"))


def blame_rollup(symbols: DataFrame, blame: DataFrame, now: int) -> DataFrame:
    """AGG-16, EXT-27: per symbol (id, file, line_start, line_end): lines, authors, primary author, last change, tenure.

    blame: (path, line, author, ts in seconds). A range join as an equi-join: the symbol's lines are spelt out.
    """
    lines = symbols.where("line_start IS NOT NULL AND line_end >= line_start").select("id", F.col("file").alias("path"), F.explode(F.sequence("line_start", "line_end")).alias("line"))
    each = lines.join(blame, ["path", "line"]).groupBy("id", "author").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    rolled = each.groupBy("id").agg(
        F.sum("n").alias("lines"), F.count(F.lit(1)).alias("author_count"), F.min(F.struct((-F.col("n")).alias("n"), "author")).alias("top"), F.max("last").alias("last_modified"), F.min("first").alias("first")
    )
    return rolled.select("id", "lines", "author_count", F.col("top.author").alias("primary_author"), "last_modified", F.floor((F.lit(now) - F.col("first")) / 86400).cast("int").alias("tenure_days"))


def fallbacks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-08: nodes with is_fallback, fallback_confidence, fallback_ratio, naming_score and the five indicators.

    edges may have is_conditional, is_in_catch, is_in_else, pipeline_order; nodes may have is_sequential (try blocks, if
    chains or later stages in the body) and catch_calls (names called in catch blocks). What is missing counts as false.
    """

    def flag(df: DataFrame, name: str):
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)

    order = F.coalesce(F.col("pipeline_order"), F.lit(0)) if "pipeline_order" in edges.columns else F.lit(0)
    catch = F.coalesce(F.col("catch_calls"), F.array().cast("array<string>")) if "catch_calls" in nodes.columns else F.array().cast("array<string>")
    callers = nodes.select(F.col("id").alias("source_id"), flag(nodes, "is_sequential").alias("sequential"), catch.alias("catches"))
    into = edges.select("source_id", "target_id", "type", flag(edges, "is_conditional").alias("cond"), flag(edges, "is_in_catch").alias("caught"), flag(edges, "is_in_else").alias("other"), order.alias("stage"))
    seen = into.join(callers, "source_id", "left").join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id")
    call = F.col("type") == "CALLS"
    has = F.size("catches") > 0
    sums = seen.groupBy(F.col("target_id").alias("id")).agg(
        F.count(F.lit(1)).alias("incoming"), F.count_if(call).alias("calls"), F.count_if(call & F.col("sequential").isNotNull()).alias("callers"), F.count_if(call & F.col("sequential")).alias("late"),
        F.count_if(call & (F.col("cond") | F.col("caught") | F.col("other"))).alias("conditional"), F.count_if(has).alias("catchers"), F.count_if(has & F.array_contains("catches", F.col("target_name"))).alias("errors"),
        F.count_if(call & (F.col("cond") | F.col("caught") | (F.col("stage") > 1))).alias("second"),
    )
    joined = nodes.join(sums, "id", "left").fillna(0, ["incoming", "calls", "callers", "late", "conditional", "catchers", "errors", "second"])
    late = F.when(F.col("callers") > 0, F.col("late") / F.col("callers")).otherwise(0.0)
    conditional = F.col("conditional") / F.greatest(F.col("incoming"), F.lit(1))
    errors = F.col("errors") / F.greatest(F.col("catchers"), F.lit(1))
    ratio = F.col("second") / F.greatest(F.col("calls"), F.lit(1))
    naming = risk.naming_score(F.col("name"))
    points = (late > 0.7).cast("int") + (conditional > 0.5).cast("int") + (F.col("errors") > 0).cast("int") + (naming > 0.3).cast("int") + (ratio > 0.5).cast("int")
    sure = risk.cap(0.3 * late + 0.25 * conditional + 0.25 * errors + 0.1 * naming + 0.1 * ratio)
    return joined.select(*nodes.columns, (points >= 3).alias("is_fallback"), F.round(sure, 6).alias("fallback_confidence"), F.round(ratio, 6).alias("fallback_ratio"), F.round(naming, 6).alias("naming_score"))


def risk_composite(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-02, MET-03: (id, is_fallback, fallback_risk, risk)."""
    f = with_degrees(fallbacks(nodes, edges), edges)
    own = risk.fallback_risk(F.col("is_fallback"), F.col("fallback_confidence"), F.col("fallback_ratio"), nz("complexity", 1), nz("tenure_days"), F.col("naming_score"))
    total = risk.composite(F.col("is_fallback"), gravity=nz("gravity"), complexity=risk.cap(nz("complexity", 1) / 20), entropy=nz("entropy"), churn=risk.cap(nz("churn") / 100), fan_out=risk.cap(F.col("out_degree") / 10), fallback=own)
    return f.select("id", "is_fallback", F.round(own, 6).alias("fallback_risk"), F.round(total, 6).alias("risk"))


def recommendation(confidence: Column, ratio: Column, complexity: Column, tenure: Column) -> Column:
    """MET-09: what to do with a suspected fallback."""
    unused = (confidence > 0.8) & (ratio < 0.2) & (complexity > 15)
    return F.when(unused, "remove").when((confidence > 0.7) & (tenure > 730), "review").when(ratio > 0.8, "monitor").otherwise("inspect")


def similarity(edges: DataFrame, a: str, b: str) -> DataFrame:
    """MET-07, SET-05: one row: the Jaccard similarity of two nodes' downstream targets."""
    own = edges.where(F.col("source_id").isin(a, b)).groupBy("target_id").agg(F.max((F.col("source_id") == a).cast("int")).alias("x"), F.max((F.col("source_id") == b).cast("int")).alias("y"))
    return own.agg(F.round(F.coalesce(F.try_divide(F.count_if((F.col("x") == 1) & (F.col("y") == 1)), F.count(F.lit(1))), F.lit(0.0)), 6).alias("similarity"))


def type_histogram(nodes: DataFrame) -> DataFrame:
    """AGG-13."""
    return nodes.groupBy("semantic_kind").agg(F.count(F.lit(1)).alias("n"))


def graph_similarity(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame) -> DataFrame:
    """GR-35, SET-06: one row: density, mean energy and type similarity of two graphs, percent and verdict.

    Energy is 2 in + out of each node that exists.
    """

    def signature(nodes: DataFrame, edges: DataFrame, x: str) -> DataFrame:
        e = with_degrees(nodes.select("id"), edges).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(2 * F.col("in_degree") + F.col("out_degree")), F.lit(0.0)).alias(f"energy_{x}"))
        return e.crossJoin(edges.agg(F.count(F.lit(1)).alias("m"))).select(F.coalesce(F.try_divide("m", "n"), F.lit(0.0)).alias(f"density_{x}"), f"energy_{x}")

    types = type_histogram(nodes_a).withColumnRenamed("n", "x").join(type_histogram(nodes_b).withColumnRenamed("n", "y"), "semantic_kind", "full").fillna(0, ["x", "y"])
    weights = types.agg(F.sum(F.least("x", "y")).alias("both"), F.sum(F.greatest("x", "y")).alias("either"))
    one = signature(nodes_a, edges_a, "a").crossJoin(signature(nodes_b, edges_b, "b")).crossJoin(weights)  # three rows of one each
    near = lambda p, q: 1 - F.abs(F.col(p) - F.col(q)) / F.greatest(F.col(p), F.col(q), F.lit(1.0))
    density, kinetic = near("density_a", "density_b"), near("energy_a", "energy_b")
    typology = F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0)
    total = 0.3 * density + 0.3 * kinetic + 0.4 * typology
    verdict = F.when(total > 0.9, "identical").when(total > 0.7, "strong").when(total > 0.4, "partial").otherwise("weak")
    return one.select(F.floor(total * 100 + 0.5).cast("int").alias("similarity"), F.round(density, 6).alias("density"), F.round(kinetic, 6).alias("kinetic"), F.round(typology, 6).alias("typology"), verdict.alias("verdict"))


def column_occupancy(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """DIA-05, AGG-07: (column_name, filled, total), one pass over the table."""
    counted = nodes.agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(c) for c in columns))
    return counted.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns))).alias("x")).select("x.column_name", "x.filled", "total")

