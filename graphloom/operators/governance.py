"""Governance: advice, policy rules, structural audit, dead code, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degrees, stats, strong_components
from .history import hidden_coupling
from .metrics import risk_advisor, split_scores

_ADVICE = ("level", "kind", "node", "detail")


def cross_file_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GOV-01: (id, component, size) of components, without containment, that span more than one file."""
    found = strong_components(edges, ("MEMBER_OF", "CONTAINS"))
    files = found.join(nodes.select("id", "file"), "id").groupBy("component").agg(F.countDistinct("file").alias("files")).where("files > 1")
    return found.join(files.select("component"), "component", "left_semi").select("id", "component", "size")


def mark_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with anomaly = cycle where GOV-01 finds one."""
    hit = cross_file_cycles(nodes, edges).select("id", F.lit("cycle").alias("found"))
    had = F.col("anomaly") if "anomaly" in nodes.columns else F.lit(None).cast("string")
    return nodes.join(hit, "id", "left").withColumn("anomaly", F.coalesce("found", had)).drop("found")


def hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GOV-02: (id, degree) above five times the median out-degree and above ten."""
    limit = F.broadcast(stats(nodes, edges).select(F.greatest(F.col("median_degree") * 5, F.lit(10)).alias("limit")))  # one row
    return nodes.select("id").join(degrees(edges), "id").crossJoin(limit).where("degree > limit").select("id", "degree")


def intuition(nodes: DataFrame) -> DataFrame:
    """GOV-03, JN-19: (literal_id, symbol_id): string literals that are another file's symbol name."""
    text = nodes.where(F.col("semantic_kind").isin("string", "string_fragment")).select(F.col("id").alias("literal_id"), F.regexp_replace("name", "['\"]", "").alias("name"), F.col("file").alias("literal_file"))
    return text.join(nodes.select(F.col("id").alias("symbol_id"), "name", "file"), "name").where("literal_id <> symbol_id AND NOT (literal_file <=> file)").select("literal_id", "symbol_id")


def external_coupling(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """GOV-06: (id, n): nodes with more than ``limit`` DEPENDS_ON edges of their own and of their unit scope."""
    deps = edges.where("type = 'DEPENDS_ON'").groupBy(F.col("source_id").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    own = nodes.where("semantic_kind IS NULL OR semantic_kind <> 'external_dependency'").select("id", F.explode(F.array("id", F.concat("id", F.lit("::unit")))).alias("s"))
    return own.join(deps, "s").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > limit)


def unpinned(dependencies: DataFrame) -> DataFrame:
    """GOV-07: rows (.., version) whose version is loose."""
    v = F.coalesce("version", F.lit("latest"))
    return dependencies.where(v.isin("latest", "*") | v.contains("^") | v.contains("~"))


def advice(nodes: DataFrame, edges: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """GOV-01 to GOV-08 in one table: (level, kind, node, detail)."""
    text = lambda *c: F.concat_ws(" ", *c)
    parts = [
        cross_file_cycles(nodes, edges).select(F.lit("ERROR"), F.lit("CIRCULAR"), "id", "component"),
        hubs(nodes, edges).select(F.lit("WARNING"), F.lit("HUB"), "id", F.col("degree").cast("string")),
        intuition(nodes).select(F.lit("INFO"), F.lit("INTUITION"), "literal_id", "symbol_id"),
        risk_advisor(nodes, edges).where("risk > 0.4").orderBy(F.col("risk").desc(), "id").limit(10).select(F.lit("WARNING"), F.lit("RISK"), "id", F.col("risk").cast("string")),
        external_coupling(nodes, edges).select(F.lit("WARNING"), F.lit("EXTERNAL_COUPLING"), "id", F.col("n").cast("string")),
        split_scores(nodes.where(F.col("semantic_kind").isin("struct", "class", "module", "package")), edges).where("score > 0.6").orderBy(F.col("score").desc(), "id").limit(5).select(F.lit("WARNING"), F.lit("STABILITY_RISK"), "id", F.col("score").cast("string")),
    ]
    if "version" in nodes.columns:
        parts.append(unpinned(nodes.where("semantic_kind = 'external_dependency'")).select(F.lit("INFO"), F.lit("UNPINNED"), "id", F.coalesce("version", F.lit("latest"))))
    if commits is not None:
        parts.append(hidden_coupling(commits, nodes, edges).select(F.lit("WARNING"), F.lit("HIDDEN_COUPLING"), text("file_a", "file_b"), F.col("confidence").cast("string")))
    whole = parts[0].toDF(*_ADVICE)
    for p in parts[1:]:
        whole = whole.unionByName(p.toDF(*_ADVICE))
    return whole


def policy_violations(nodes: DataFrame, edges: DataFrame, rules: list[dict], files: DataFrame | None = None) -> DataFrame:
    """GOV-09: (node_id, rule_id, message). rules: dictionaries with id, type, matchPath, matchLabel, target, max.

    Labels match the language kind or the structural kind. files: (path) for require_file.
    """
    spark = nodes.sparkSession
    parts = []
    for rule in rules:
        own, kind, target = nodes, rule["type"], rule.get("target")
        if kind == "require_file":
            known = files.select("path") if files is not None else nodes.select(F.col("file").alias("path"))
            wanted = spark.createDataFrame([(target,)], "path string")
            parts.append(wanted.join(known.where(F.col("path") == target), "path", "left_anti").select(F.lit("global").alias("node_id"), F.lit(rule["id"]).alias("rule_id"), F.lit(f"missing file {target}").alias("message")))
            continue
        if rule.get("matchPath"):
            own = own.where(F.col("id").rlike(rule["matchPath"]))
        if rule.get("matchLabel"):
            own = own.where((F.col("semantic_kind") == rule["matchLabel"]) | (F.col("canonical_kind") == rule["matchLabel"]))
        if kind == "require_heritage":
            ends = F.col("target_id").endswith(f"::{target.lower()}") | F.col("target_id").endswith(f"::{target}")
            good = edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS", "TYPE_REFERENCE") & ends).select(F.col("source_id").alias("id"))
            bad, message = own.join(good, "id", "left_anti"), F.lit(f"missing heritage {target}")
        elif kind == "require_export":
            bad, message = own.where(~F.coalesce("is_exported", F.lit(False))), F.lit("must be exported")
        elif kind == "require_caller":
            callers = nodes.where(F.col("name") == target).select(F.col("id").alias("source_id"))
            good = edges.join(callers, "source_id", "left_semi").select(F.col("target_id").alias("id"))
            bad, message = own.join(good, "id", "left_anti"), F.lit(f"must be called by {target}")
        elif kind == "framework_check":
            has = F.array_contains("frameworks", target) if "frameworks" in nodes.columns else F.lit(False)
            bad, message = own.where(~F.coalesce(has, F.lit(False))), F.lit(f"missing framework {target}")
        elif kind == "max_fans":
            limit = rule.get("max") or 30
            fans = edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fans")).where(F.col("fans") > limit)
            bad, message = own.join(fans, "id"), F.format_string(f"%d fans, limit {limit}", "fans")
        else:
            raise ValueError(f"unknown rule type {kind!r}")
        parts.append(bad.select(F.col("id").alias("node_id"), F.lit(rule["id"]).alias("rule_id"), message.alias("message")))
    whole = parts[0] if parts else spark.createDataFrame([], "node_id string, rule_id string, message string")
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def framework_coverage(nodes: DataFrame) -> DataFrame:
    """AGG-15: nodes per framework in an array column ``frameworks``."""
    return nodes.select(F.explode("frameworks").alias("framework")).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))


def audit(nodes: DataFrame, edges: DataFrame, root: str = "/") -> DataFrame:
    """GR-34: (type, id, source): circular violations, broken internal links, external discoveries.

    A component is hierarchical, and no violation, if a MEMBER_OF edge runs inside it. A missing target is internal if it
    is a path under ``root`` or begins with ``@/``.
    """
    found = strong_components(edges).where("size > 1")
    inside = edges.where("type = 'MEMBER_OF'").join(found.select(F.col("id").alias("source_id"), F.col("component").alias("a")), "source_id").join(found.select(F.col("id").alias("target_id"), F.col("component").alias("b")), "target_id").where("a = b").select(F.col("a").alias("component")).distinct()
    circular = found.join(inside, "component", "left_anti").groupBy("component").agg(F.min("id").alias("id")).select(F.lit("CIRCULAR").alias("type"), "id", F.col("component").alias("source"))
    lost = edges.where("type <> 'MEMBER_OF'").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").join(nodes.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
    t = F.col("target_id")
    pathlike = t.startswith("/") | t.startswith("./") | t.startswith("../") | t.startswith("@/")
    internal = pathlike & (t.startswith(root) | t.startswith("@/")) & ~t.startswith("node:")
    orphans = lost.select(F.when(internal, "REFACTOR").otherwise("ECOSYSTEM").alias("type"), t.alias("id"), F.coalesce("name", "source_id").alias("source"))
    return circular.unionByName(orphans)


def audit_summary(found: DataFrame) -> DataFrame:
    """GR-34: one row: success, cycles, orphans, ecosystem_dangling."""
    n = lambda k: F.count_if(F.col("type") == k)
    return found.agg(((n("CIRCULAR") == 0) & (n("REFACTOR") == 0)).alias("success"), n("CIRCULAR").alias("cycles"), n("REFACTOR").alias("orphans"), n("ECOSYSTEM").alias("ecosystem_dangling"))


# What the names of entry points hold, for dead code.
_ENTRY_PARTS = ("main", "index", "app", "handler", "setup")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-27: (id, finding): ORPHAN before UNUSED_EXPORT; STALE_IMPORT for unused import clauses."""
    own = nodes.select(F.col("id").alias("source_id"), F.col("file").alias("source_file"))
    seen = edges.join(own, "source_id", "left").join(nodes.select(F.col("id").alias("target_id"), F.col("file").alias("target_file")), "target_id")
    sums = seen.groupBy(F.col("target_id").alias("id")).agg(
        F.count(F.lit(1)).alias("incoming"), F.count_if(F.col("source_file").isNotNull() & ~F.col("source_file").eqNullSafe(F.col("target_file"))).alias("external"), F.count_if(F.col("type").isin("CALLS", "ACCESSES")).alias("used")
    )
    joined = nodes.join(sums, "id", "left").fillna(0, ["incoming", "external", "used"])
    name = F.lower(F.coalesce("name", F.lit("")))
    entry = F.lit(False)
    for part in _ENTRY_PARTS:
        entry = entry | name.contains(part)
    orphan = F.col("canonical_kind").isin("STRUCTURE", "BEHAVIOR", "ATOM", "INFRA") & (F.col("incoming") == 0) & ~entry
    unused = F.coalesce("is_exported", F.lit(False)) & (F.col("external") == 0) & ~entry
    stale = F.col("semantic_kind").isin("import_clause", "import_specifier") & (F.col("used") == 0)
    rest = F.array_compact(F.array(F.when(unused, F.lit("UNUSED_EXPORT")), F.when(stale, F.lit("STALE_IMPORT"))))
    return joined.select("id", F.explode(F.when(orphan, F.array(F.lit("ORPHAN"))).otherwise(rest)).alias("finding"))


def status(nodes: DataFrame, edges: DataFrame, commits_behind: int = 0) -> DataFrame:
    """GOV-13: one row: counts, density, staleness."""
    return stats(nodes, edges).select("node_count", "edge_count", "density", F.lit(commits_behind > 0).alias("stale"), F.lit(commits_behind).alias("commits_behind"))


def context(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """GOV-14, PRJ-06: (section, id, name, value): top gravity, top risk, and everything of risk above 0.8."""
    top = lambda c: nodes.orderBy(F.col(c).desc_nulls_last(), "id").limit(limit).select(F.lit(c).alias("section"), "id", "name", F.round(c, 6).alias("value"))
    return top("gravity").unionByName(top("risk")).unionByName(nodes.where("risk > 0.8").select(F.lit("violations").alias("section"), "id", "name", F.round("risk", 6).alias("value")))
