"""Tables from text: commit logs, diffs, blame, manifests, ignore lists, files, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RULES

# Globs that are always ignored.
IGNORED = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/venv/**", "**/.venv/**", "**/target/**", "**/vendor/**", "**/Gems/**",
    "**/.bundle/**", "**/Pods/**", "**/.build/**", "**/.swiftpm/**", "**/bin/**", "**/obj/**", "**/out/**", "**/.gradle/**", "**/.mvn/**",
    "**/Debug/**", "**/Release/**", "**/x64/**", "**/ipch/**", "**/*.d.ts", "**/*.map", "**/*.db", "**/*.sqlite", "**/*.log",
)


def commits(log: DataFrame) -> DataFrame:
    """SRC-12, WIN-07: (hash, path) of a log (log_id, line_no, line): ``COMMIT:<hash>`` lines, names under them.

    The last marker above a line is carried forward inside its log, so logs are read side by side.
    """
    mark = F.when(F.col("line").startswith("COMMIT:"), F.expr("substring(line, 8)"))
    above = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = log.withColumn("hash", F.last(mark, ignorenulls=True).over(above))
    return tagged.where(~F.col("line").startswith("COMMIT:") & (F.trim("line") != "") & F.col("hash").isNotNull()).select("hash", F.trim("line").alias("path"))


def hunks(diffs: DataFrame) -> DataFrame:
    """SRC-13: (diff_id, file, start, len) of unified diffs (diff_id, text); a length that isn't given is 1."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    name = F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)"))
    above = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("file", F.last(name, ignorenulls=True).over(above)).where(F.col("line").startswith("@@") & F.col("file").isNotNull())
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    size = F.regexp_extract("line", pattern, 2)
    return tagged.where(F.col("line").rlike(pattern)).select("diff_id", "file", F.regexp_extract("line", pattern, 1).cast("int").alias("start"), F.when(size == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -\\\\d+(?:,\\\\d+)? \\\\+(\\\\d+)(?:,(\\\\d+))? @@', 2) AS INT)")).alias("len"))


def blame(text: DataFrame) -> DataFrame:
    """SRC-09: (path, line, author, ts) of porcelain blame (path, line_no, text)."""
    head = r"^[0-9a-f]{40} \d+ (\d+)"
    above = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(c, ignorenulls=True).over(above)
    tagged = text.select(
        "path", "text", carried(F.when(F.col("text").rlike(head), F.regexp_extract("text", head, 1))).alias("line"),
        carried(F.when(F.col("text").startswith("author "), F.expr("substring(text, 8)"))).alias("author"), carried(F.when(F.col("text").startswith("author-time "), F.expr("substring(text, 13)"))).alias("ts"),
    )
    return tagged.where(F.col("text").startswith("\t")).select("path", F.col("line").cast("int").alias("line"), "author", F.col("ts").cast("long").alias("ts"))


def package_json(files: DataFrame) -> DataFrame:
    """SRC-17: (path, name, version, scope) of (path, source)."""
    parts = []
    for scope, key in (("prod", "dependencies"), ("dev", "devDependencies")):
        found = F.from_json(F.get_json_object("source", f"$.{key}"), "map<string,string>")
        parts.append(files.select("path", F.explode(found).alias("name", "version"), F.lit(scope).alias("scope")))
    return parts[0].unionByName(parts[1])


def requirements(files: DataFrame) -> DataFrame:
    """SRC-18: (path, name, version) of (path, source); without a constraint the version is ``latest``."""
    line = files.select("path", F.explode(F.split("source", "\n")).alias("line")).select("path", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    pattern = r"^([A-Za-z0-9_.\-]+)\s*(.*)$"
    rest = F.trim(F.regexp_extract("line", pattern, 2))
    return line.where(F.col("line").rlike(pattern)).select("path", F.regexp_extract("line", pattern, 1).alias("name"), F.when(rest == "", "latest").otherwise(rest).alias("version"))


def framework(name: Column, source: Column) -> Column:
    """SRC-19: the framework that a file (base name) declares or imports, the first in this order; null if none."""
    deps = lambda key: F.coalesce(F.get_json_object(source, f"$.dependencies.{key}"), F.get_json_object(source, f"$.devDependencies.{key}")).isNotNull()
    imports = lambda key: source.contains(f"from {key} import") | source.contains(f"import {key}")
    listed = F.when(source.contains("fastapi"), "fastapi").when(source.contains("flask"), "flask").when(source.contains("django"), "django")
    packaged = F.when(deps("next"), "nextjs").when(deps("express"), "express")
    imported = F.when(imports("fastapi"), "fastapi").when(imports("flask"), "flask")
    return F.when(name == "requirements.txt", listed).when(name == "package.json", packaged).when(name.endswith(".py"), imported)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**`` any path, ``*`` and ``?`` inside a segment; without a slash it fits any basename."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c
            i += 1
    return f"^{'' if '/' in glob else '(?:.*/)?'}{out}$"


def not_ignored(files: DataFrame, more: Sequence[str] = (), path: str = "path") -> DataFrame:
    """SRC-14: files that no glob fits; the globs become one expression that runs in the scan's stage."""
    globs = [g for g in (*IGNORED, *more) if g.strip() and not g.startswith("#")]
    return files.where(~F.col(path).rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)))


def files(spark: SparkSession, root: str, extensions: Sequence[str] = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "c", "cpp", "cs", "php", "rb", "swift"), modified_after: str | None = None) -> DataFrame:
    """SRC-02, SRC-03, SRC-05, SRC-15: (path, source, mtime) of a folder's source files, ignored ones left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    found = reader.load(root).select("path", F.col("content").cast("string").alias("source"), F.col("modificationTime").alias("mtime"))
    return not_ignored(found)


def under(files_: DataFrame, root: str) -> DataFrame:
    """SRC-16."""
    return files_.where(F.col("path").startswith(root))


def config_files(files_: DataFrame, names: Sequence[str]) -> DataFrame:
    """SRC-26: files by exact base name."""
    return files_.where(F.element_at(F.split("path", "/"), -1).isin(*names))


def project_of(files_: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC-27, JN-13: (path, root): the longest root that is a leading folder of a path.

    A path's leading folders are spelt out and joined by equality, so no pair of all paths and roots is made.
    """
    parts = F.split("path", "/")
    folders = files_.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return folders.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-25."""
    return spark.read.schema(RULES).option("multiLine", True).json(path)


def guides(spark: SparkSession, path: str) -> DataFrame:
    """SRC-28: (path, title, description, text) of Markdown files."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.select("path", F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1).alias("title"), F.regexp_extract("text", r"(?m)^description:\s*(.+)$", 1).alias("description"), "text")
