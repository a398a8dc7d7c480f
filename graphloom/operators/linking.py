"""Linking: bare call targets, imports, routes, argument handover, virtual libraries, rebinding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import first

# Ecosystems that a target may name before "::".
ECOSYSTEMS = ("global", "npm", "std", "pip", "gem", "mvn", "go", "crates")
# Edges whose bare targets are resolved.
RESOLVABLE = ("CALLS", "CONSTRUCTS", "TYPE_REFERENCE", "ACCESSES")


def resolve_bare_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-28, JN-06: (id, new_target_id) of edges whose target has no ``::``: a symbol of the source's file, else of the
    files that it imports, the first import (by edge id) that has it. Names are compared in lower case; of several symbols
    of a name in a file the heaviest, then the smallest id, counts."""
    named = nodes.where("unit_id IS NOT NULL AND name IS NOT NULL AND lower(name) NOT IN ('', 'unit') AND contains(id, '::')")
    symbols = first(named.select(F.lower("unit_id").alias("unit"), F.lower("name").alias("symbol"), F.col("id").alias("found"), F.coalesce("gravity", F.lit(0.0)).alias("g")), ["unit", "symbol"], F.col("g").desc(), "found").drop("g")
    bare = edges.where(F.col("type").isin(*RESOLVABLE) & ~F.col("target_id").contains("::"))
    unit = F.coalesce(F.lower("unit_id"), F.when(F.col("source_id").endswith("::unit"), F.col("source_id")))
    bare = bare.join(nodes.select(F.col("id").alias("source_id"), "unit_id"), "source_id", "left").select("id", unit.alias("unit"), F.lower("target_id").alias("symbol")).where("unit IS NOT NULL")
    same = bare.join(symbols, ["unit", "symbol"]).select("id", "found", F.lit("").alias("via"))
    imports = edges.where("type = 'IMPORTS'").select(F.lower("source_id").alias("unit"), F.lower("target_id").alias("other"), F.col("id").alias("via"))
    other = bare.join(imports, "unit").join(symbols.select(F.col("unit").alias("other"), "symbol", "found"), ["other", "symbol"]).select("id", "found", "via")
    best = same.unionByName(other).groupBy("id").agg(F.min(F.struct("via", "found")).alias("b"))
    return best.select("id", F.col("b.found").alias("new_target_id"))


def rebind(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """SNK-06, GR-21: edges with the targets of (id, new_target_id)."""
    return edges.join(updates, "id", "left").withColumn("target_id", F.coalesce("new_target_id", "target_id")).drop("new_target_id").select(*edges.columns)


def set_gravity(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """SNK-05: nodes with the gravity of (id, gravity)."""
    return nodes.join(ranks.select("id", F.col("gravity").alias("new")), "id", "left").withColumn("gravity", F.coalesce("new", "gravity")).drop("new").select(*nodes.columns)


def prefix_local_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-07: a target t of an edge out of file f becomes ``f::t`` where that node exists."""
    file = F.substring_index("source_id", "::", 1)
    tried = edges.withColumn("candidate", F.concat(file, F.lit("::"), F.lower("target_id")))
    known = nodes.select(F.col("id").alias("candidate"), F.lit(True).alias("known"))
    return tried.join(known, "candidate", "left").withColumn("target_id", F.when(F.col("known"), F.col("candidate")).otherwise(F.col("target_id"))).select(*edges.columns)


def link_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR-29, JN-10: (source_id, target_id, confidence) for import nodes (id, name, target_path): the definition
    ``path::name`` if it exists, else the only function or class of that name, with confidence 0.7."""
    wanted = imports.withColumn("target", F.concat(F.lower("target_path"), F.lit("::"), F.lower("name")))
    exact = wanted.join(nodes.select(F.col("id").alias("target")), "target").select(F.col("id").alias("source_id"), F.col("target").alias("target_id"), F.lit(1.0).alias("confidence"))
    only = nodes.where(F.col("semantic_kind").isin("function", "class")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target_id")).where("n = 1")
    rest = wanted.join(exact.select(F.col("source_id").alias("id")), "id", "left_anti").join(only, "name").select(F.col("id").alias("source_id"), "target_id", F.lit(0.7).alias("confidence"))
    return exact.unionByName(rest)


def url_pattern(template: Column) -> Column:
    """A route template as a regular expression: ``{x}`` and ``:x`` stand for one segment, a final slash is dropped."""
    t = F.regexp_replace(F.coalesce(template, F.lit("")), "/$", "")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(t, r"\{[^}]+\}", "[^/]+"), r":[^/]+", "[^/]+"), F.lit("$"))


def bind_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """JN-14: (request_id, route_id) where methods agree and the url fits the template.

    The join is on the method and the number of segments, which every placeholder keeps; the pattern is the residual.
    """
    parts = lambda c: F.size(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "/$", ""), "/"))
    a = requests.select(F.col("id").alias("request_id"), F.col("method"), F.regexp_replace(F.coalesce("url", F.lit("")), "/$", "").alias("url"), parts("url").alias("n"))
    b = routes.select(F.col("id").alias("route_id"), F.col("method"), url_pattern(F.col("path")).alias("pattern"), parts("path").alias("n"))
    return a.join(b, ["method", "n"]).where("url RLIKE pattern").select("request_id", "route_id")


def handovers(edges: DataFrame) -> DataFrame:
    """JN-15: (source_id, target_id, variable, call_id): what an assignment of a node produces and one of its calls takes.

    edges: with reason and arguments (array<string>); of several producers of a name the first by edge id counts.
    """
    made = edges.where("reason = 'assignment'").select(F.col("source_id").alias("node"), F.element_at(F.split("target_id", "::"), -1).alias("variable"), F.col("target_id").alias("producer"), "id")
    made = first(made, ["node", "variable"], "id").drop("id")
    used = edges.where("type = 'CALLS'").select(F.col("source_id").alias("node"), F.col("id").alias("call_id"), "target_id", F.explode("arguments").alias("variable"))
    return used.join(made, ["node", "variable"]).select(F.col("producer").alias("source_id"), "target_id", "variable", "call_id").distinct()


def virtual_libraries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """EXT-30: (id, name, file, canonical_kind, canonical_rank, parent_id) of the libraries and symbols that dangling targets name."""
    lost = edges.select(F.lower("target_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    parts = F.split("id", "::")
    split = lost.select("id", F.when(F.size(parts) >= 2, parts[0]).otherwise("unresolved").alias("namespace"), F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(F.col("id")).alias("symbol"), (F.size(parts) >= 2).alias("scoped"))
    fits = F.when(F.col("scoped"), F.col("namespace").isin(*ECOSYSTEMS)).otherwise(~F.col("id").startswith("/") & ~F.col("id").startswith("c:\\"))
    own = split.where(fits)
    lib = F.concat(F.lit("lib::"), "namespace")
    symbols = own.select("id", F.col("symbol").alias("name"), F.concat(F.lit("external://"), "namespace", F.lit("/"), "symbol").alias("file"), F.lit("BEHAVIOR").alias("canonical_kind"), F.lit(7).alias("canonical_rank"), lib.alias("parent_id"))
    libraries = own.select(lib.alias("id"), F.col("namespace").alias("name"), F.concat(F.lit("external://"), "namespace").alias("file")).distinct().join(nodes.select("id"), "id", "left_anti")
    return symbols.unionByName(libraries.select("id", "name", "file", F.lit("STRUCTURE").alias("canonical_kind"), F.lit(1).alias("canonical_rank"), F.lit(None).cast("string").alias("parent_id")))
