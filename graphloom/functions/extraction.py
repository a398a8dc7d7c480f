"""Symbols and references from source text, line by line, in SQL functions: one file's lines form a window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .taxonomy import is_infra_name

# What looks like a call but isn't.
NOT_CALLS = ("if", "elif", "def", "while", "for", "return", "class", "import", "from", "await", "switch", "catch", "function")
# Markers of debt.
DEBT = ("TODO", "FIXME", "HACK", "BUG", "REFACTOR", "DEPRECATED", "XXX")
# Files of each language.
EXTENSIONS = {
    "python": ("py",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx"), "go": ("go",), "java": ("java",), "rust": ("rs",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "hpp"), "csharp": ("cs",), "php": ("php",), "ruby": ("rb",), "swift": ("swift",),
}
# Branches of each language, as words and operators that a regular expression can count.
BRANCHES = {
    "python": r"\b(if|elif|for|while|except|and|or|with|assert)\b", "typescript": r"\b(if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?=[^.:?])",
    "javascript": r"\b(if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?=[^.:?])", "go": r"\b(if|for|case|select)\b|&&|\|\|", "java": r"\b(if|for|while|case|catch)\b|&&|\|\||\?(?=[^.:?])",
    "rust": r"\b(if|for|while|match|loop)\b|&&|\|\|", "c": r"\b(if|for|while|case)\b|&&|\|\||\?(?=[^.:?])", "cpp": r"\b(if|for|while|case|catch)\b|&&|\|\||\?(?=[^.:?])",
    "csharp": r"\b(if|for|foreach|while|case|catch)\b|&&|\|\||\?\?", "php": r"\b(if|elseif|for|foreach|while|case|catch)\b|&&|\|\|", "ruby": r"\b(if|elsif|unless|while|until|when|rescue)\b|&&|\|\|",
    "swift": r"\b(if|guard|for|while|case|catch)\b|&&|\|\||\?\?",
}

# The line rules that say what a class, a function, an import and a call of these languages is. They decide
# which symbols and edges a file has, so results only agree where they are the same.
_CLASS = r"^(\s*)(?:export\s+)?(?:abstract\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)"
_FUNCTION = r"^(\s*)(?:export\s+)?(?:async\s+)?(?:def|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
_PY_IMPORT = r"^(?:from\s+([a-zA-Z0-9_\.]+)\s+)?import\s+([a-zA-Z0-9_,\s]+)"
_TS_IMPORT = r"^(?:import|export)\s+.*from\s+['\"]([^'\"]+)['\"]"
_CALL = r"\b([a-zA-Z_][a-zA-Z0-9_\.]*)\s*\("


def language(path: Column) -> Column:
    """EXT-26: by extension, null if unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, endings in EXTENSIONS.items():
        out = F.when(extension.isin(*endings), name).otherwise(out)
    return out


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line, indent) of Python, TypeScript and JavaScript files, without blank lines, and the
    class and symbol that each stands under."""
    own = files.where(language(F.col("path")).isin("python", "typescript", "javascript")).select(F.lower("path").alias("path"), F.posexplode(F.split("source", "\n")).alias("i", "line"))
    own = own.where(F.col("line").rlike(r"\S")).withColumn("line_no", F.col("i") + 1)
    own = own.withColumn("indent", F.length(F.regexp_extract("line", r"^(\s*)", 1)))
    is_class, is_function = F.col("line").rlike(_CLASS), F.col("line").rlike(_FUNCTION)
    above = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("class_name", F.when(is_class, F.regexp_extract("line", _CLASS, 2))).withColumn("function_name", F.when(~is_class & is_function, F.regexp_extract("line", _FUNCTION, 2)))
    own = own.withColumn("in_class", F.last("class_name", True).over(above)).withColumn("class_indent", F.last(F.when(is_class, F.col("indent")), True).over(above))
    method = F.col("in_class").isNotNull() & (F.col("indent") > F.col("class_indent"))
    own = own.withColumn("is_method", F.col("function_name").isNotNull() & F.coalesce(method, F.lit(False)))
    symbol = F.coalesce("class_name", F.when(F.col("is_method"), F.concat_ws(".", "in_class", "function_name")).otherwise(F.col("function_name")))
    own = own.withColumn("symbol", symbol)
    return own.withColumn("scope", F.coalesce(F.last("symbol", True).over(above), F.lit("unit"))).drop("i")


def symbols(files: DataFrame) -> DataFrame:
    """EXT-02, EXT-04: (id, path, name, canonical_kind, line_start, parent_id, unit_id, is_exported) and a row per file."""
    unit = F.concat("path", F.lit("::unit"))
    found = lines(files).where("symbol IS NOT NULL")
    name = F.coalesce("class_name", "function_name")
    kind = F.when(F.col("class_name").isNotNull() & is_infra_name(F.col("class_name")), "INFRA").when(F.col("class_name").isNotNull(), "STRUCTURE").otherwise("BEHAVIOR")
    own = found.select(F.concat(unit, F.lit("::"), name).alias("id"), "path", F.col("symbol").alias("name"), kind.alias("canonical_kind"), F.col("line_no").alias("line_start"), F.when(F.col("is_method"), F.concat(unit, F.lit("::"), "in_class")).alias("parent_id"), unit.alias("unit_id"), F.col("line").contains("export").alias("is_exported"))
    low = F.lower("path")
    units = files.select(F.concat(low, F.lit("::unit")).alias("id"), low.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("STRUCTURE").alias("canonical_kind"), F.lit(0).alias("line_start"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("unit_id"), F.lit(True).alias("is_exported"))
    return units.unionByName(own)


def imports(files: DataFrame) -> DataFrame:
    """EXT-07: (path, line_no, specifier)."""
    python = F.when(F.col("line").rlike(_PY_IMPORT), F.coalesce(F.nullif(F.regexp_extract("line", _PY_IMPORT, 1), F.lit("")), F.trim(F.element_at(F.split(F.regexp_extract("line", _PY_IMPORT, 2), ","), 1))))
    script = F.when(F.col("line").rlike(_TS_IMPORT), F.regexp_extract("line", _TS_IMPORT, 1))
    return lines(files).select("path", "line_no", F.coalesce(python, script).alias("specifier")).where("specifier IS NOT NULL AND specifier <> ''")


def calls(files: DataFrame) -> DataFrame:
    """EXT-08: (path, line_no, scope, target, confidence): names before a bracket, keywords left out."""
    found = lines(files).select("path", "line_no", "scope", F.explode(F.expr(f"regexp_extract_all(line, r'{_CALL}', 1)")).alias("target"))
    return found.where(~F.col("target").isin(*NOT_CALLS)).withColumn("confidence", F.lit(0.8))


def call_type(target: Column) -> Column:
    """EXT-08: CONSTRUCTS for names that begin with a capital, else CALLS."""
    return F.when(target.rlike("^[A-Z]"), "CONSTRUCTS").otherwise("CALLS")


def heritage_type(target: Column) -> Column:
    """EXT-10."""
    return F.when(target.rlike("^I[A-Z]|Interface$|Trait$"), "IMPLEMENTS").otherwise("EXTENDS")


def fingerprint(path: Column, name: Column, flags: Column) -> Column:
    """EXT-05."""
    return F.sha2(F.concat_ws("|", path, name, flags), 256)


def debt_markers(text: Column, more: tuple[str, ...] = ()) -> Column:
    """EXT-21: the markers that occur, in their fixed order."""
    return F.filter(F.array(*(F.lit(m) for m in (*DEBT, *more))), lambda m: F.contains(text, m))


def complexity(source: Column, path: Column) -> Column:
    """EXT-20: one more than the branches, with what TypeScript, Rust and C# add, rounded up."""
    out = F.lit(1.0)
    name = language(path)
    for lang, pattern in BRANCHES.items():
        n = 1.0 + F.regexp_count(source, F.lit(pattern))
        if lang == "typescript":
            n = n + 0.5 * F.regexp_count(source, F.lit(r"\buse[A-Z]\w*\s*\("))
        elif lang == "rust":
            n = n + 0.5 * F.regexp_count(source, F.lit(r"\?(?=[;.)])"))
        elif lang == "csharp":
            n = n + 2.0 * F.regexp_count(source, F.lit(r"\bfrom\s+\w+\s+in\b")) + 0.5 * F.regexp_count(source, F.lit(r"\bawait\b"))
        out = F.when(name == lang, n).otherwise(out)
    return F.ceil(out).cast("int")


def visibility(name: Column, lang: Column, path: Column, declaration: Column) -> Column:
    """EXT-22."""
    python = F.when(name.rlike(r"^__(?!.*__$)"), "private").when(name.startswith("_"), "protected").otherwise("public")
    go = F.when(path.contains("/internal/"), "protected").when(name.rlike("^[A-Z]"), "public").otherwise("private")
    word = F.regexp_extract(declaration, r"\b(private|protected|public)\b", 1)
    return F.when(lang == "python", python).when(lang == "go", go).when(word != "", word).otherwise("public")


def doc_text(source: Column) -> Column:
    """EXT-23: the first docstring or block comment, trimmed; null if there is none."""
    found = F.regexp_extract(source, r'(?s)"""(.*?)"""|/\*\*(.*?)\*/', 0)
    return F.nullif(F.trim(F.regexp_replace(found, r'^("""|/\*\*)|("""|\*/)$', "")), F.lit(""))


def routes(files: DataFrame) -> DataFrame:
    """EXT-12: (id, path, method, route, line_no) of decorators and router calls."""
    pattern = r"(?:@\w+|\b(?:app|router))\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"
    own = lines(files).where(F.col("line").rlike(pattern))
    method, route = F.upper(F.regexp_extract("line", pattern, 1)), F.regexp_extract("line", pattern, 2)
    return own.select(F.concat_ws("::", F.lit("ROUTE"), route, method).alias("id"), "path", method.alias("method"), route.alias("route"), "line_no")


def requests(files: DataFrame) -> DataFrame:
    """EXT-13: (id, path, method, url, line_no) of calls of HTTP clients, never of routers."""
    pattern = r"\b(?:axios|requests|http|httpx|client|session)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]|\b(fetch)\(\s*['\"]([^'\"]+)['\"]"
    own = lines(files).where(F.col("line").rlike(pattern))
    url = F.concat(F.regexp_extract("line", pattern, 2), F.regexp_extract("line", pattern, 4))
    method = F.coalesce(F.nullif(F.upper(F.regexp_extract("line", pattern, 1)), F.lit("")), F.lit("GET"))
    return own.select(F.concat_ws("::", F.lit("REQUEST"), url, method).alias("id"), "path", method.alias("method"), url.alias("url"), "line_no")


def assignments(files: DataFrame) -> DataFrame:
    """EXT-11: (path, line_no, scope, name, value)."""
    pattern = r"^\s*(?:const\s+|let\s+|var\s+)?([A-Za-z_]\w*)\s*=\s*([^=].*)$"
    return lines(files).where(F.col("line").rlike(pattern)).select("path", "line_no", "scope", F.regexp_extract("line", pattern, 1).alias("name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))


def hierarchy(paths: DataFrame, repository: str) -> DataFrame:
    """EXT-29: (id, canonical_kind, canonical_rank, name, parent_id): ecosystem, repository, all folders, files of relative paths."""
    parts = F.split("path", "/")
    folders = paths.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("d")).distinct()
    repo = f"repository::{repository}"
    up = lambda c: F.when(F.contains(c, F.lit("/")), F.concat(F.lit("directory::"), F.regexp_replace(c, "/[^/]+$", ""))).otherwise(F.lit(repo))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    spark = paths.sparkSession
    roots = spark.createDataFrame([("ecosystem::global", "ECOSYSTEM", 0, "global", None), (repo, "REPOSITORY", 1, repository, "ecosystem::global")], "id string, canonical_kind string, canonical_rank int, name string, parent_id string")
    dirs = folders.select(F.concat(F.lit("directory::"), "d").alias("id"), F.lit("NAMESPACE").alias("canonical_kind"), F.lit(2).alias("canonical_rank"), base(F.col("d")).alias("name"), up(F.col("d")).alias("parent_id"))
    units = paths.select(F.concat("path", F.lit("::unit")).alias("id"), F.lit("UNIT").alias("canonical_kind"), F.lit(3).alias("canonical_rank"), base(F.col("path")).alias("name"), up(F.col("path")).alias("parent_id"))
    return roots.unionByName(dirs).unionByName(units)


def import_candidates(imports_: DataFrame, suffixes: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py", ".go", ".rs", "/mod.rs", ".rb", ".java", ".cs", ".php")) -> DataFrame:
    """EXT-15: (path, specifier, candidate, priority) of relative, dotted and bare specifiers.

    A Python specifier climbs one folder for each dot after the first; one that climbs past the top has no file there.
    """
    folder = F.regexp_replace("path", "/?[^/]+$", "")
    up = F.length(F.regexp_extract("specifier", r"^(\.+)", 1))
    dotted = F.col("specifier").rlike(r"^(\.*[A-Za-z_][\w.]*|\.+)$") & F.col("path").endswith(".py")
    relative = F.regexp_replace(F.concat(folder, F.lit("/"), F.regexp_replace("specifier", r"^\./", "")), r"^/", "")
    for _ in range(4):
        relative = F.regexp_replace(relative, r"(^|/)[^/.][^/]*/\.\./", "$1")
    module = F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/")
    # one dot is the file's own folder, each further one a folder up
    above = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - up + 1, F.lit(0))), "/")
    climbed = F.regexp_replace(F.concat_ws("/", F.nullif(above, F.lit("")), F.nullif(module, F.lit(""))), r"^/", "")
    base = F.when(dotted & (up > 0), climbed).when(dotted, module).when(F.col("specifier").startswith("."), relative).otherwise(F.col("specifier"))
    tried = imports_.select("path", "specifier", F.lower(base).alias("base"), F.posexplode(F.array(*(F.lit(s) for s in suffixes))).alias("priority", "suffix"))
    return tried.select("path", "specifier", F.concat("base", F.regexp_replace("suffix", "", "")).alias("candidate"), "priority")


def resolve_imports(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """EXT-15, JN-09: (path, specifier, target): the first candidate, by priority, that is a file.

    Of EXT-16 to EXT-19 only the dots of Python and the files and folder entries of each language (suffixes) are covered.
    """
    known = files.select(F.lower("path").alias("candidate")).distinct()
    return import_candidates(imports_).join(known, "candidate").groupBy("path", "specifier").agg(F.min(F.struct("priority", "candidate")).alias("b")).select("path", "specifier", F.col("b.candidate").alias("target"))


def rename_plan(files: DataFrame, old: str, new: str) -> DataFrame:
    """SNK-16: (path, edits, renamed): files that hold a name as a whole word, and their text with another; nothing is written.

    Both names are taken as they are: no character of them is a pattern or a reference to one.
    """
    word = r"[\p{Alnum}_]"
    edges = (rf"(?<!{word})" if re.match(r"\w", old) else "", rf"(?!{word})" if re.match(r".*\w$", old, re.S) else "")
    pattern = edges[0] + "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in old) + edges[1]
    quoted = re.sub(r"([\\$])", r"\\\1", new)
    return files.where(F.col("source").rlike(pattern)).select("path", F.regexp_count("source", F.lit(pattern)).cast("long").alias("edits"), F.regexp_replace("source", pattern, quoted).alias("renamed"))
