"""Registered queries over texts: extraction, manifests, logs, diffs, linking, and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import extraction as X
from ..operators import linking, search
from ..sources import texts
from ..streaming import changes
from .loops import scratch, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SOURCES = [
    ("src/runner.py", "import os\nfrom app.util import helper\n\nclass LoomRunner:\n    def explore(self):\n        if helper(1) and os.path(2):\n            return Thing()  # TODO later\n\ndef main():\n    run(LoomRunner())\n"),
    ("src/app/util.py", "def helper(x):\n    # FIXME: slow\n    for i in range(x):\n        print(i)\n    return x\n"),
    ("src/index.ts", "import { start } from './feature'\nexport const x = 1;\nexport class IndexService {\n  function go() { return start(x); }\n}\n"),
    ("src/feature.ts", "export function start() {\n  console.log(\"Init\");\n  const y = x ? 1 : 2;\n  return fetch('/api/users/7');\n}\n"),
    ("src/api.py", "@app.get('/api/users/{id}')\ndef users(id):\n    value = load(id)\n    return value\n"),
    ("node_modules/ignored.ts", "export const nothing = 1;\n"),
]


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _quote(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(_quote(v) for v in r) + ')' for r in rows)})"


_FILES = _values("files", "path, source", SOURCES)
_LINES = f"""WITH {_FILES}
, l0 AS (SELECT path, unnest(string_split(source, chr(10))) AS line, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS line_no FROM files)
, l1 AS (SELECT *, length(regexp_extract(line, '^(\\s*)', 1)) AS indent, nullif(regexp_extract(line, '^(\\s*)(?:export\\s+)?(?:abstract\\s+)?class\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 2), '') AS cls,
  nullif(regexp_extract(line, '^(\\s*)(?:export\\s+)?(?:async\\s+)?(?:def|function)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 2), '') AS fn FROM l0 WHERE regexp_matches(line, '\\S'))
, l2 AS (SELECT *, last_value(cls IGNORE NULLS) OVER w AS in_class, last_value(CASE WHEN cls IS NOT NULL THEN indent END IGNORE NULLS) OVER w AS ci FROM l1 WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING))
, l3 AS (SELECT *, fn IS NOT NULL AND coalesce(in_class IS NOT NULL AND indent > ci, FALSE) AS is_method FROM l2)
, l4 AS (SELECT *, coalesce(cls, CASE WHEN is_method THEN in_class || '.' || fn ELSE fn END) AS symbol FROM l3)
, l5 AS (SELECT *, coalesce(last_value(symbol IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'unit') AS scope FROM l4)
"""


def files(spark: SparkSession):
    return spark.createDataFrame(SOURCES, "path string, source string")


def on_files(f):
    return lambda spark, d: f(files(spark))


add("extract_symbols", on_files(lambda f: X.symbols(f).select("id", "name", "canonical_kind", "line_start", "parent_id", "is_exported")), _LINES + """
SELECT path || '::unit::' || coalesce(cls, fn) AS id, symbol AS name, CASE WHEN cls IS NOT NULL AND regexp_matches(cls, '(Service|Router|Controller|Registry|Store|Runner|Manager|Engine|Writer|Reporter|Provider|Client)$') THEN 'INFRA' WHEN cls IS NOT NULL THEN 'STRUCTURE' ELSE 'BEHAVIOR' END AS canonical_kind,
  CAST(line_no AS INTEGER) AS line_start, CASE WHEN is_method THEN path || '::unit::' || in_class END AS parent_id, contains(line, 'export') AS is_exported FROM l5 WHERE symbol IS NOT NULL
UNION ALL SELECT path || '::unit', string_split(path, '/')[-1], 'STRUCTURE', 0, NULL, TRUE FROM files""")
add("extract_imports", on_files(X.imports), _LINES + """
SELECT path, CAST(line_no AS INTEGER) AS line_no, specifier FROM (SELECT path, line_no, CASE WHEN regexp_matches(line, '^(?:from\\s+([a-zA-Z0-9_\\.]+)\\s+)?import\\s+([a-zA-Z0-9_,\\s]+)') THEN coalesce(nullif(regexp_extract(line, '^(?:from\\s+([a-zA-Z0-9_\\.]+)\\s+)?import\\s+([a-zA-Z0-9_,\\s]+)', 1), ''), trim(string_split(regexp_extract(line, '^(?:from\\s+([a-zA-Z0-9_\\.]+)\\s+)?import\\s+([a-zA-Z0-9_,\\s]+)', 2), ',')[1]))
  WHEN regexp_matches(line, '^(?:import|export)\\s+.*from\\s+[''"]([^''"]+)[''"]') THEN regexp_extract(line, '^(?:import|export)\\s+.*from\\s+[''"]([^''"]+)[''"]', 1) END AS specifier FROM l5) WHERE specifier <> ''""")
add("extract_calls", on_files(X.calls), _LINES + """
SELECT path, CAST(line_no AS INTEGER) AS line_no, scope, target, 0.8e0 AS confidence FROM (SELECT path, line_no, scope, unnest(regexp_extract_all(line, '\\b([a-zA-Z_][a-zA-Z0-9_\\.]*)\\s*\\(', 1)) AS target FROM l5)
WHERE target NOT IN ('if', 'elif', 'def', 'while', 'for', 'return', 'class', 'import', 'from', 'await', 'switch', 'catch', 'function')""")
add("debt_markers", on_files(lambda f: f.select("path", F.array_join(X.debt_markers(F.col("source")), ",").alias("markers"))), f"WITH {_FILES} SELECT path, array_to_string(list_filter(['TODO', 'FIXME', 'HACK', 'BUG', 'REFACTOR', 'DEPRECATED', 'XXX'], lambda m: contains(source, m)), ',') AS markers FROM files")
add("complexity_regex", on_files(lambda f: f.where("path LIKE '%.py'").select("path", X.complexity(F.col("source"), F.col("path")).alias("complexity"))), f"WITH {_FILES} SELECT path, CAST(1 + len(regexp_extract_all(source, '\\b(if|elif|for|while|except|and|or|with|assert)\\b')) AS INTEGER) AS complexity FROM files WHERE path LIKE '%.py'")
add("language_dispatch", on_files(lambda f: f.select("path", X.language(F.col("path")).alias("language"))), f"WITH {_FILES} SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language FROM files")
add("ignored_files", on_files(lambda f: texts.not_ignored(f).select("path")), f"WITH {_FILES} SELECT path FROM files WHERE path NOT LIKE '%node_modules/%'")
add("extract_routes", on_files(X.routes), f"SELECT 'ROUTE::/api/users/{{id}}::GET' AS id, 'src/api.py' AS path, 'GET' AS method, '/api/users/{{id}}' AS route, CAST(1 AS INTEGER) AS line_no")
add("extract_requests", on_files(X.requests), "SELECT 'REQUEST::/api/users/7::GET' AS id, 'src/feature.ts' AS path, 'GET' AS method, '/api/users/7' AS url, CAST(4 AS INTEGER) AS line_no")
add("route_binding", on_files(lambda f: linking.bind_routes(X.requests(f).select("id", "method", "url"), X.routes(f).select("id", "method", F.col("route").alias("path")))), "SELECT 'REQUEST::/api/users/7::GET' AS request_id, 'ROUTE::/api/users/{id}::GET' AS route_id")
add("resolve_imports", on_files(lambda f: X.resolve_imports(X.imports(f), f)), "SELECT 'src/index.ts' AS path, './feature' AS specifier, 'src/feature.ts' AS target")
add("rename_plan", on_files(lambda f: X.rename_plan(f, "helper", "assist")), f"WITH {_FILES} SELECT path, len(regexp_extract_all(source, '\\bhelper\\b')) AS edits, regexp_replace(source, '\\bhelper\\b', 'assist', 'g') AS renamed FROM files WHERE regexp_matches(source, '\\bhelper\\b')")
add("folder_hierarchy", on_files(lambda f: X.hierarchy(f.select("path"), "demo").select("id", "canonical_kind", "canonical_rank", "parent_id")), """SELECT * FROM (VALUES ('ecosystem::global', 'ECOSYSTEM', 0, NULL), ('repository::demo', 'REPOSITORY', 1, 'ecosystem::global'), ('directory::src', 'NAMESPACE', 2, 'repository::demo'),
 ('directory::src/app', 'NAMESPACE', 2, 'directory::src'), ('directory::node_modules', 'NAMESPACE', 2, 'repository::demo'), ('src/runner.py::unit', 'UNIT', 3, 'directory::src'), ('src/app/util.py::unit', 'UNIT', 3, 'directory::src/app'), ('src/index.ts::unit', 'UNIT', 3, 'directory::src'),
 ('src/feature.ts::unit', 'UNIT', 3, 'directory::src'), ('src/api.py::unit', 'UNIT', 3, 'directory::src'), ('node_modules/ignored.ts::unit', 'UNIT', 3, 'directory::node_modules')) AS t(id, canonical_kind, canonical_rank, parent_id)""")

_MANIFESTS = [("a/package.json", '{"dependencies": {"express": "^4.1.0", "left": "1.0.0"}, "devDependencies": {"jest": "latest"}}'), ("b/package.json", '{"name": "b"}')]
add("manifest_dependencies", lambda s, d: texts.package_json(s.createDataFrame(_MANIFESTS, "path string, source string")), "SELECT * FROM (VALUES ('a/package.json', 'express', '^4.1.0', 'prod'), ('a/package.json', 'left', '1.0.0', 'prod'), ('a/package.json', 'jest', 'latest', 'dev')) AS t(path, name, version, scope)")
add("requirements_dependencies", lambda s, d: texts.requirements(s.createDataFrame([("r.txt", "# pinned\nflask==2.0\n\nnumpy\nuvicorn[standard]>=1\n")], "path string, source string")), "SELECT * FROM (VALUES ('r.txt', 'flask', '==2.0'), ('r.txt', 'numpy', 'latest'), ('r.txt', 'uvicorn', '[standard]>=1')) AS t(path, name, version)")
add("unpinned_dependencies", lambda s, d: _unpinned(s), "SELECT 'express' AS name, '^4.1.0' AS version UNION ALL SELECT 'jest', 'latest'")


def _unpinned(s):
    from ..operators.governance import unpinned

    return unpinned(texts.package_json(s.createDataFrame(_MANIFESTS, "path string, source string"))).select("name", "version")


_LOG = ["COMMIT:aaa", "src/x.ts", "src/y.ts", "", "COMMIT:bbb", "src/x.ts"]
add("commit_log", lambda s, d: texts.commits(s.createDataFrame([("l", i, t) for i, t in enumerate(_LOG)], "log_id string, line_no int, line string")), "SELECT * FROM (VALUES ('aaa', 'src/x.ts'), ('aaa', 'src/y.ts'), ('bbb', 'src/x.ts')) AS t(hash, path)")
_DIFF = "diff --git a/user/25 b/user/25\n--- a/user/25\n+++ b/user/25\n@@ -1,2 +3,2 @@\n-x\n+y\n@@ -9 +45 @@ def f\n+++ b/user/26\n@@ -0,0 +61,20 @@\n"


def _hunks(s):
    return texts.hunks(s.createDataFrame([("d", _DIFF)], "diff_id string, text string")).select("file", "start", "len")


add("diff_hunks", lambda s, d: _hunks(s), "SELECT * FROM (VALUES ('user/25', 3, 2), ('user/25', 45, 1), ('user/26', 61, 20)) AS t(file, start, len)")


def _changed(s, d):
    from .analysis import week

    n, _ = week(s, d)
    return search.changed_symbols(n, _hunks(s))


add("diff_hunk_symbols", _changed)


def _changed_sql() -> str:
    from .analysis import W
    from .fixtures import prefix

    return f"""{prefix("an", "ae")}{W}, l(file, line) AS (SELECT 'user/25', unnest([3, 4, 45]) UNION ALL SELECT 'user/26', unnest(range(61, 81)))
, r AS (SELECT n2.id, row_number() OVER (PARTITION BY l.file, l.line ORDER BY line_end - line_start, n2.id) AS r FROM l JOIN n2 ON n2.file = l.file AND l.line BETWEEN line_start AND line_end) SELECT DISTINCT id FROM r WHERE r = 1"""


ORACLES["diff_hunk_symbols"] = _changed_sql()

_NODES = [("a.py::unit", "a.py", "a.py::unit"), ("a.py::f", "f", "a.py::unit"), ("b.py::unit", "b.py", "b.py::unit"), ("b.py::g", "g", "b.py::unit"), ("c.py::g", "g", "c.py::unit"), ("c.py::h", "h", "c.py::unit")]
_EDGES = [("1", "a.py::unit", "b.py::unit", "IMPORTS"), ("2", "a.py::unit", "c.py::unit", "IMPORTS"), ("3", "a.py::f", "g", "CALLS"), ("4", "a.py::f", "H", "CALLS"), ("5", "a.py::f", "f", "CALLS"), ("6", "a.py::f", "zzz", "CALLS"), ("7", "b.py::g", "f", "CALLS")]
add("resolve_bare_targets", lambda s, d: linking.resolve_bare_targets(s.createDataFrame(_NODES, "id string, name string, unit_id string").withColumn("gravity", F.lit(0.0)), s.createDataFrame(_EDGES, "id string, source_id string, target_id string, type string")),
    "SELECT * FROM (VALUES ('3', 'b.py::g'), ('4', 'c.py::h'), ('5', 'a.py::f')) AS t(id, new_target_id)")
_FLOWS = [("1", "a::f", "a::x", "ACCESSES", "assignment", None), ("2", "a::f", "b::use", "CALLS", None, ["x", "y"]), ("3", "a::f", "c::x", "ACCESSES", "assignment", None), ("4", "q::g", "b::use", "CALLS", None, ["x"])]
add("argument_handover", lambda s, d: linking.handovers(s.createDataFrame(_FLOWS, "id string, source_id string, target_id string, type string, reason string, arguments array<string>")), "SELECT 'a::x' AS source_id, 'b::use' AS target_id, 'x' AS variable, '2' AS call_id")
add("link_imports", lambda s, d: linking.link_imports(s.createDataFrame([("i1", "f", "a.py"), ("i2", "H", "nowhere.py"), ("i3", "g", "nowhere.py")], "id string, name string, target_path string"), s.createDataFrame([("a.py::f", "f", "function"), ("x.py::h", "H", "class"), ("b.py::g", "g", "function"), ("c.py::g", "g", "function")], "id string, name string, semantic_kind string")),
    "SELECT * FROM (VALUES ('i1', 'a.py::f', 1.0e0), ('i2', 'x.py::h', 0.7e0)) AS t(source_id, target_id, confidence)")
add("project_of_file", lambda s, d: texts.project_of(s.createDataFrame([("r/a/x.ts",), ("r/a/b/y.ts",), ("q/z.ts",)], "path string"), s.createDataFrame([("r",), ("r/a/b",)], "root string")), "SELECT * FROM (VALUES ('r/a/x.ts', 'r'), ('r/a/b/y.ts', 'r/a/b')) AS t(path, root)")


def _streamed(spark: SparkSession, sf_dir: str):
    """Edges of the event stream counted per day, run to the end of what is there."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", False).parquet(sf_dir)
    edges = events.select(F.concat(F.lit("user::"), "user_id").alias("source_id"), F.col("event_type").alias("target_id"), F.lit("CALLS").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    top = scratch(spark, "stream")
    counted = changes.edge_counts(edges, late="60 days")
    out = f"{top}/out"

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    last = found.groupBy("window_start", "source_id", "target_id", "type").agg(F.max_by("weight", "batch").alias("weight"))
    return written(last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source_id", "target_id", "weight"))


add("stream_edge_counts", _streamed, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'user::' || user_id AS source_id, event_type AS target_id, count(*) AS weight FROM events GROUP BY ALL")
