"""Expressions over text and paths."""

from pyspark.sql import functions as F

from graphloom.functions import extraction as X, risk, taxonomy
from graphloom.operators import linking, metrics, search
from graphloom.sources import texts


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(value.alias("v")).first()["v"]


def test_globs():
    import re

    fits = lambda g, p: bool(re.match(texts.glob_pattern(g), p))
    assert fits("**/node_modules/**", "node_modules/x.ts") and fits("**/node_modules/**", "a/node_modules/b/c")
    assert not fits("**/node_modules/**", "a/my_node_modules/c")
    assert fits("**/*.d.ts", "a/b.d.ts") and not fits("**/*.d.ts", "a/bxd.ts")
    assert fits("notes.md", "a/notes.md") and fits("*.log", "x.log") and not fits("*.log", "x.log/y")


def test_path_proximity(spark):
    value = lambda a, b: one(spark, risk.path_proximity(F.lit(a), F.lit(b)))
    assert value("src/a/x", "src/a/y") == 2 / 3
    assert value("src", "src") == 1.0
    assert value("a/b", "c/d/e") == 0.0
    assert value("a", "a/b/c") == 0.5


def test_jaccard_and_naming(spark):
    assert one(spark, risk.jaccard(F.array(), F.array())) == 0.0
    assert one(spark, risk.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == 1 / 3
    assert one(spark, risk.naming_score(F.lit("legacy backup"))) == 3 / 5
    assert one(spark, risk.naming_score(F.lit(None).cast("string"))) == 0.0


def test_taxonomy(spark):
    kinds = [r.v for r in spark.createDataFrame([("Class",), ("method",), ("zzz",), (None,)], "k string").select(taxonomy.canonical_kind(F.col("k")).alias("v")).collect()]
    assert kinds == ["STRUCTURE", "BEHAVIOR", "ATOM", None]
    assert one(spark, taxonomy.is_infra_name(F.lit("LoomRunner")))


def test_visibility_and_docs(spark):
    see = lambda n, lang, d="": one(spark, X.visibility(F.lit(n), F.lit(lang), F.lit("p"), F.lit(d)))
    assert [see("__x", "python"), see("_x", "python"), see("x", "python"), see("X", "go"), see("x", "go"), see("x", "typescript", "private x()")] == ["private", "protected", "public", "public", "private", "private"]
    assert one(spark, X.doc_text(F.lit('def f():\n  """ Says hi. """\n'))) == "Says hi."
    assert one(spark, X.doc_text(F.lit("x"))) is None
    assert one(spark, X.heritage_type(F.lit("IThing"))) == "IMPLEMENTS" and one(spark, X.heritage_type(F.lit("Thing"))) == "EXTENDS"
    assert one(spark, X.call_type(F.lit("Thing"))) == "CONSTRUCTS"


def test_complexity_of_languages(spark):
    c = lambda src, path: one(spark, X.complexity(F.lit(src), F.lit(path)))
    assert c("if (a && b) { useState(1) }", "x.ts") == 4  # 1 + if + && + 0.5, rounded up
    assert c("match x { _ => y?; }", "x.rs") == 3
    assert c("", "x.go") == 1 and c("whatever", "x.unknown") == 1


def test_snippet_promotes_infra_and_finds_methods(spark):
    src = spark.createDataFrame([("m.py", "class LoomRunner:\n    def explore(self):\n        go()\n")], "path string, source string")
    got = {r.name: (r.canonical_kind, r.parent_id) for r in X.symbols(src).collect()}
    assert got["LoomRunner"] == ("INFRA", None) and got["LoomRunner.explore"] == ("BEHAVIOR", "m.py::unit::LoomRunner")


def test_blame_and_assignments(spark):
    h = "a" * 40
    rows = [("f", i, t) for i, t in enumerate([f"{h} 1 1 2", "author Ann", "author-time 100", "\tx = 1", f"{h} 2 2", "author Bob", "author-time 200", "\ty"])]
    got = texts.blame(spark.createDataFrame(rows, "path string, line_no int, text string")).collect()
    assert {(r.line, r.author, r.ts) for r in got} == {(1, "Ann", 100), (2, "Bob", 200)}
    symbols = spark.createDataFrame([("s", "f", 1, 2)], "id string, file string, line_start int, line_end int")
    row = metrics.blame_rollup(symbols, spark.createDataFrame(got), 86400 * 3 + 100).first()
    assert (row.lines, row.author_count, row.primary_author, row.tenure_days) == (2, 2, "Ann", 3)
    a = X.assignments(spark.createDataFrame([("f.py", "x = call(1)\nif x == 2:\n")], "path string, source string")).collect()
    assert [(r.name, r.value) for r in a] == [("x", "call(1)")]


def test_route_templates(spark):
    routes = spark.createDataFrame([("r1", "GET", "/a/{id}/"), ("r2", "GET", "/a/:id/b"), ("r3", "POST", "/a/{id}")], "id string, method string, path string")
    requests = spark.createDataFrame([("q1", "GET", "/a/7"), ("q2", "GET", "/a/7/b/"), ("q3", "GET", None)], "id string, method string, url string")
    assert {(r.request_id, r.route_id) for r in linking.bind_routes(requests, routes).collect()} == {("q1", "r1"), ("q2", "r2")}


def test_modules_are_found_only_where_nothing_else_is(spark):
    symbols = spark.createDataFrame([("m", "f", 1, 100, "module"), ("c", "f", 10, 50, "class"), ("g", "f", 20, 30, "function")], "id string, file string, line_start int, line_end int, semantic_kind string")
    places = spark.createDataFrame([("f", 25), ("f", 40), ("f", 90), ("f", 900)], "file string, line int")
    assert {r.line: r.id for r in search.symbols_at(symbols, places).collect()} == {25: "g", 40: "c", 90: "m"}


def test_change_risk(spark):
    symbols = spark.createDataFrame([("s", "f", "f", 1, 9, "function", 0.5, 20, 0.0, 0)], "id string, name string, file string, line_start int, line_end int, semantic_kind string, gravity double, complexity int, entropy double, churn int").withColumn("tenure_days", F.lit(1))
    e = spark.createDataFrame([("s", "t", "CALLS")], "source_id string, target_id string, type string")
    total, top = search.change_risk(symbols, e, spark.createDataFrame([("f", 3, 2)], "file string, start int, len int"))
    row = total.first()
    assert row.symbols == 1 and abs(row.risk - 10 * (0.5 * 0.25 + 0.35 + 0.1 * 0.15)) < 1e-9
    assert top.count() == 1
    advise = lambda *x: one(spark, metrics.recommendation(*map(F.lit, x)))
    assert [advise(0.9, 0.05, 20, 1), advise(0.9, 0.05, 1, 800), advise(0.1, 0.9, 1, 1), advise(0.1, 0.1, 1, 1)] == ["remove", "review", "monitor", "inspect"]


def test_frameworks(spark):
    rows = [("requirements.txt", "flask==2\ndjango"), ("package.json", '{"devDependencies": {"express": "1"}}'), ("package.json", "{"), ("a.py", "from fastapi import X"), ("b.py", "flask"), ("c.ts", "import express")]
    df = spark.createDataFrame(rows, "name string, source string")
    assert [r.v for r in df.select(texts.framework(F.col("name"), F.col("source")).alias("v")).collect()] == ["flask", "express", None, "fastapi", None, None]


def test_relative_imports_climb_a_folder_for_each_further_dot(spark):
    cases = {
        ("pkg/a/b/c.py", ".util"): "pkg/a/b/util.py", ("pkg/a/b/c.py", "..util"): "pkg/a/util.py", ("pkg/a/b/c.py", "...util"): "pkg/util.py", ("pkg/a/b/c.py", "....util"): "util.py",
        ("pkg/a/b/c.py", "..sub.deep"): "pkg/a/sub/deep.py", ("pkg/a/b/c.py", ".."): "pkg/a/__init__.py", ("top.py", ".util"): "util.py", ("pkg/a/b/c.py", "pkg.util"): "pkg/util.py",
        ("web/x/y.ts", "../util"): "web/util.ts", ("web/x/y.ts", "./util"): "web/x/util.ts",
    }
    files = spark.createDataFrame([(p,) for p in {"pkg/a/b/util.py", "pkg/a/util.py", "pkg/util.py", "util.py", "pkg/a/sub/deep.py", "pkg/a/__init__.py", "web/util.ts", "web/x/util.ts"}], "path string")
    got = X.resolve_imports(spark.createDataFrame(list(cases), "path string, specifier string"), files)
    assert {(r.path, r.specifier): r.target for r in got.collect()} == cases


def test_renaming_takes_names_as_they_are(spark):
    files = spark.createDataFrame([("1", "a.b axb a.bc xa.b (a.b)"), ("2", "axb"), ("3", "x$y + $y")], "path string, source string")
    assert {r.path: (r.edits, r.renamed) for r in X.rename_plan(files, "a.b", "c$1\\d").collect()} == {"1": (2, "c$1\\d axb a.bc xa.b (c$1\\d)")}
    assert {r.path: r.renamed for r in X.rename_plan(files, "axb", "q").collect()} == {"1": "a.b q a.bc xa.b (a.b)", "2": "q"}
    assert {r.path: (r.edits, r.renamed) for r in X.rename_plan(files, "$y", "z").collect()} == {"3": (2, "xz + z")}
