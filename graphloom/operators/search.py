"""Finding symbols: ranked search, pattern queries, by name, by line, by diff hunk."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """GR-18: (id, score): a node's own matches times its rank (1 if 0), plus half of each match that it points to.

    Per token: name equal 100, else within 20; label 5; path 10; kind equal 50; rank equal 10. Scores below 2 give no
    echo. Own score and echoes are added, in whatever order rows come.
    """
    name, label, file = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "semantic_kind", "file"))
    kind, rank = F.lower(F.coalesce("canonical_kind", F.lit(""))), F.coalesce(F.col("canonical_rank").cast("string"), F.lit(""))
    score = F.lit(0)
    for token in query.lower().split():
        score = score + F.when(name == token, 100).when(name.contains(token), 20).otherwise(0)
        for test, points in ((label.contains(token), 5), (file.contains(token), 10), (kind == token, 50), (rank == token, 10)):
            score = score + F.when(test, points).otherwise(0)
    weight = F.when(F.coalesce("gravity", F.lit(0.0)) == 0, 1.0).otherwise(F.col("gravity"))
    own = nodes.where((name != "") | (label != "")).select("id", (score * weight).alias("score")).where("score > 0")
    echo = own.where(F.col("score") * 0.5 >= 1).select(F.col("id").alias("target_id"), (F.col("score") * 0.5).alias("score")).join(edges.select("source_id", "target_id"), "target_id")
    echo = echo.select(F.col("source_id").alias("id"), "score").join(nodes.select("id"), "id", "left_semi")
    return own.unionByName(echo).groupBy("id").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def by_name(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """GR-17: nodes of exactly this name; only if there are none, those whose name or label holds it, case ignored."""
    exact = nodes.where(F.col("name") == name)
    low = name.lower()
    fuzzy = nodes.where(F.lower("name").contains(low) | F.lower("semantic_kind").contains(low)).where(F.col("name") != name)
    found = exact.withColumn("stage", F.lit(0)).unionByName(fuzzy.withColumn("stage", F.lit(1)))
    best = F.broadcast(found.agg(F.min("stage").alias("stage")))  # one row
    return found.join(best, "stage", "left_semi").drop("stage").orderBy("id").limit(limit)


_PATTERN = re.compile(r"^\s*\(\s*:?\s*(\w*)\s*\)\s*-\s*\[\s*:?\s*(\w+|\*)?\s*\]\s*->\s*\(\s*:?\s*(\w*)\s*\)\s*$")


def pattern(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """GR-22, JN-22: ``(Label)-[:TYPE]->(Label)``: (source, type, target, source_file, target_file, confidence).

    An empty label is any, ``*`` any type; labels match parts of the language or structural kind, case ignored.
    """
    m = _PATTERN.match(text)
    if not m:
        raise ValueError(f"not a pattern: {text!r}")
    a, kind, b = m.group(1).lower(), (m.group(2) or "*").upper(), m.group(3).lower()

    def labelled(label: str) -> DataFrame:
        if not label:
            return nodes
        return nodes.where(F.lower(F.coalesce("semantic_kind", F.lit(""))).contains(label) | F.lower(F.coalesce("canonical_kind", F.lit(""))).contains(label))

    own = edges if kind == "*" else edges.where(F.upper("type") == kind)
    source = labelled(a).select(F.col("id").alias("source_id"), F.col("name").alias("source"), F.col("file").alias("source_file"))
    target = labelled(b).select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("file").alias("target_file"))
    return own.join(source, "source_id").join(target, "target_id").select("source_id", "source", "type", "target_id", "target", "source_file", "target_file", "confidence")


def symbols_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """GR-19, WIN-05, FLT-15: (file, line, id): the innermost symbol around each place (file, line).

    Modules count only where nothing else does. Equi-join on the file, then the smallest range by a map-side combined
    minimum: a file's symbols are few.
    """
    own = symbols.select("id", "file", "line_start", "line_end", F.coalesce(F.lower("semantic_kind") == "module", F.lit(False)).cast("int").alias("outer"))
    near = places.select("file", "line").distinct().join(own, "file").where("line BETWEEN line_start AND line_end")
    best = near.groupBy("file", "line").agg(F.min(F.struct("outer", (F.col("line_end") - F.col("line_start")).alias("size"), "id")).alias("b"))
    return best.select("file", "line", F.col("b.id").alias("id"))


def hunk_lines(hunks: DataFrame) -> DataFrame:
    """(file, start, len) to (file, line)."""
    return hunks.where("len > 0").select("file", F.explode(F.expr("sequence(start, start + len - 1)")).alias("line"))


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """JN-21: symbols whose range holds a changed line."""
    return symbols_at(symbols, hunk_lines(hunks)).select("id").distinct()


def change_risk(symbols: DataFrame, edges: DataFrame, hunks: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """MET-10: one row (symbols, risk out of ten), and the riskiest changed symbols."""
    from .metrics import risk_composite

    hit = risk_composite(symbols, edges).join(changed_symbols(symbols, hunks), "id", "left_semi")
    total = hit.agg(F.count(F.lit(1)).alias("symbols"), F.round(F.coalesce(F.avg("risk"), F.lit(0.0)) * 10, 6).alias("risk"))
    return total, hit.orderBy(F.col("risk").desc(), "id").limit(limit)


def first(df: DataFrame, by: list[str], *order) -> DataFrame:
    """WIN-06: the first row of each group in an explicit order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__gl_row", F.row_number().over(w)).where("__gl_row = 1").drop("__gl_row")
