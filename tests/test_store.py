"""The store: complete snapshots, purge, federation, history, refresh from a stream."""

from pyspark.sql import functions as F

from graphloom.operators import history
from graphloom.sources.store import Store, clear_file, federate
from graphloom.streaming import changes


def graph(spark, names, risk=0.5):
    n = spark.createDataFrame([(f"{u}::{s}", s, f"{u}::unit", u, risk) for u, s in names], "id string, name string, unit_id string, file string, risk double")
    e = spark.createDataFrame([(f"{u}::{s}->x", f"{u}::{s}", "X::Y", "CALLS") for u, s in names], "id string, source_id string, target_id string, type string")
    return n, e


def test_snapshots_carry_units_forward(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.latest() is None and s.nodes().count() == 0
    s.write("s1", 10, *graph(spark, [("a.py", "f"), ("b.py", "g"), ("b.py", "old")]))
    s.write("s2", 20, *graph(spark, [("b.py", "g")], 0.9), replaces=spark.createDataFrame([("b.py::unit",)], "unit_id string"))
    assert s.latest() == "s2" and s.as_of(15) == "s1" and s.as_of(5) is None
    assert {(r.id, r.risk) for r in s.nodes("s2").collect()} == {("a.py::f", 0.5), ("b.py::g", 0.9)}
    assert {r.source_id for r in s.edges("s2").collect()} == {"a.py::f", "b.py::g"}
    assert s.edges("s2").first()["target_id"] == "x::y"
    row = s.snapshots().where("id = 's2'").first()
    assert (row.node_count, row.edge_count) == (2, 2)
    assert s.node("B.PY::G", "s2").count() == 1
    assert s.sql("SELECT count(*) AS n FROM {nodes} WHERE snapshot_id = :s", s="s1").first()["n"] == 3
    d = history.drift_summary(s.nodes("s1"), s.nodes("s2")).first()
    assert d["total_symbols"] == 2
    assert {(r.id, r.change) for r in history.node_changes(s.nodes("s1"), s.nodes("s2")).collect()} == {("b.py::old", "removed")}
    assert "PartitionFilters: [isnotnull(snapshot_id" in s.nodes("s2")._jdf.queryExecution().toString()
    s.clear()
    assert s.nodes().count() == 0


def test_writing_a_snapshot_again_replaces_it(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/again")
    s.write("s1", 10, *graph(spark, [("a.py", "f")]))
    s.write("s1", 10, *graph(spark, [("a.py", "g")]))
    assert [r.id for r in s.nodes("s1").collect()] == ["a.py::g"]
    s.write("s2", 20, *graph(spark, [("a.py", "g")]))
    s.write("s1", 12, *graph(spark, [("a.py", "g"), ("b.py", "h")]))
    assert sorted((r.id, r.ts, r.node_count) for r in s.snapshots().collect()) == [("s1", 12, 2), ("s2", 20, 1)]
    assert s.latest() == "s2" and s.as_of(15) == "s1"


def test_clear_file_and_federation(spark):
    n, e = graph(spark, [("a.py", "f"), ("b.py", "g")])
    left_n, left_e = clear_file(n, e, "A.py")
    assert [r.id for r in left_n.collect()] == ["b.py::g"] and left_e.count() == 1
    both = federate([n, n.withColumn("risk", F.lit(1.0)).where("file = 'a.py'")])
    assert {r.id: r.risk for r in both.collect()} == {"a.py::f": 1.0, "b.py::g": 0.5}


def test_stream_refreshes_the_store(spark, tmp_path):
    src, s = tmp_path / "changes", Store(spark, f"file://{tmp_path}/live")
    schema = "path string, source string, change string"

    def extract(files):
        n = files.select(F.concat("path", F.lit("::f")).alias("id"), F.lit("f").alias("name"), F.concat("path", F.lit("::unit")).alias("unit_id"), F.col("path").alias("file"), F.length("source").alias("complexity"))
        return n, n.select(F.concat("id", F.lit("->x")).alias("id"), F.col("id").alias("source_id"), F.lit("x").alias("target_id"), F.lit("CALLS").alias("type"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{src}")
        stream = spark.readStream.schema(schema).json(f"file://{src}")
        changes.refresh(s, stream, extract, f"file://{tmp_path}/cp", lambda n: n).awaitTermination()

    run([("a.py", "xx", "add"), ("b.py", "yyy", "add"), ("c.py", "z", "unlink")])
    run([("b.py", "yyyyy", "change")])
    assert {(r.id, r.complexity) for r in s.nodes(s.latest()).collect()} == {("a.py::f", 2), ("b.py::f", 5)}


def test_the_last_of_several_changes_in_a_batch_counts(spark, tmp_path):
    src, s = tmp_path / "several", Store(spark, f"file://{tmp_path}/several-store")
    schema = "path string, source string, change string, at long"

    def extract(files):
        n = files.select(F.concat("path", F.lit("::f")).alias("id"), F.lit("f").alias("name"), F.concat("path", F.lit("::unit")).alias("unit_id"), F.col("path").alias("file"), F.length("source").alias("complexity"))
        return n, n.select(F.concat("id", F.lit("->x")).alias("id"), F.col("id").alias("source_id"), F.lit("x").alias("target_id"), F.lit("CALLS").alias("type"))

    rows = [("a.py", "xxxx", "change", 7), ("a.py", "x", "add", 1), ("a.py", "xx", "change", 3), ("b.py", "y", "add", 2), ("b.py", "yyy", "change", 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{src}")
    stream = spark.readStream.schema(schema).json(f"file://{src}")
    changes.refresh(s, stream, extract, f"file://{tmp_path}/several-cp", lambda n: n, time="at").awaitTermination()
    assert {(r.id, r.complexity) for r in s.nodes(s.latest()).collect()} == {("a.py::f", 4), ("b.py::f", 3)}


def test_repeated_edges_within_the_watermark_are_dropped(spark, tmp_path):
    src = tmp_path / "edges"
    spark.createDataFrame([("e1", "2024-01-01 00:00:00"), ("e1", "2024-01-01 00:01:00"), ("e2", "2024-01-01 00:02:00")], "id string, ts string").select("id", F.to_timestamp("ts").alias("ts")).write.parquet(f"file://{src}")
    stream = spark.readStream.schema("id string, ts timestamp").parquet(f"file://{src}")
    q = changes.distinct_edges(stream).writeStream.format("memory").queryName("seen_edges").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("seen_edges").collect()) == ["e1", "e2"]
