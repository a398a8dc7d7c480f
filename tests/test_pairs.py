"""Co-changing pairs against a plain count, and what a mass commit costs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from graphloom.operators import history, pairs


def _plain(rows, least, limit=None):
    by = {}
    for h, p in rows:
        if h is not None and p is not None:
            by.setdefault(h, set()).add(p)
    n = Counter(x for paths in by.values() for x in combinations(sorted(paths, key=str.encode), 2))
    found = sorted(((a, b, c) for (a, b), c in n.items() if c >= least), key=lambda x: (-x[2], x[0].encode(), x[1].encode()))
    return found if limit is None else found[:limit]


def _commits(seed=1, commits=60, paths=90):
    rng = random.Random(seed)
    names = [f"{rng.choice(['a', 'é', 'Z', '𝄞', 'user'])}/{i}" for i in range(paths)]
    rows = [(f"c{c}", rng.choice(names[: rng.choice([5, 30, paths])])) for c in range(commits) for _ in range(rng.choice([1, 3, 12]))]
    return rows + [("mass", p) for p in names] + rows[:40] + [(None, "a/0"), ("mass", None), (None, None)]


@pytest.mark.parametrize("least,limit", [(4, 7), (2, None), (1, 100), (1, 1), (3, 100_000)])
@pytest.mark.parametrize("parts", ["1", "6"])
def test_cochange_counts_every_pair(spark, least, limit, parts):
    rows, was = _commits(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = [tuple(r) for r in history.cochange(spark.createDataFrame(rows, "hash string, path string"), least - 1, limit).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = _plain(rows, least, limit)
    assert (sorted(found) if limit is None else found) == (sorted(want) if limit is None else want)


def test_cochange_of_nothing(spark):
    none = spark.createDataFrame([], "hash string, path string")
    assert history.cochange(none).collect() == [] and history.cochange(none, limit=None).collect() == []
    assert history.cochange(spark.createDataFrame([("h", "a")], none.schema), 0).collect() == []
    assert history.cochange(spark.createDataFrame([("h", "a"), ("h", "b")], none.schema), 0, 0).collect() == []
    assert history.cochange(spark.createDataFrame([("h", "a"), ("h", "b")], none.schema), 0).collect() == [Row(file_a="a", file_b="b", n=1)]


def _written(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _mass(spark):
    return spark.range(1500).selectExpr("explode(sequence(1, 5)) AS c", "id").selectExpr("'c' || c AS hash", "'p' || id AS path")


def test_mass_commits_are_not_spread_into_pairs(spark):
    """Five commits of 1500 paths: 1.1 million pairs, which were rows of the shuffle."""
    before = _written(spark)
    found = [tuple(r) for r in history.cochange(_mass(spark), 3, 3).collect()]
    assert found == [("p0", "p1", 5), ("p0", "p10", 5), ("p0", "p100", 5)]
    assert _written(spark) - before < 1_000_000


def test_hidden_coupling_of_mass_commits(spark):
    """The same commits against a graph that links p10 and p0: that pair goes, whichever way its edge points."""
    nodes = spark.createDataFrame([(f"n{i}", f"p{i}") for i in (0, 1, 10)], "id string, file string")
    edges = spark.createDataFrame([("n10", "n0"), ("n1", "n1")], "source_id string, target_id string")
    before = _written(spark)
    found = {tuple(r) for r in history.hidden_coupling(_mass(spark), nodes, edges, 3, 3).collect()}
    assert found == {("p0", "p1", 0.5), ("p0", "p100", 0.5)}
    assert _written(spark) - before < 1_000_000


class _Held:
    """Settings within a block."""

    def __init__(self, spark, **conf):
        self.spark, self.conf = spark, {f"spark.sql.{k}": v for k, v in conf.items()}

    def __enter__(self):
        self.was = {k: self.spark.conf.get(k) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.was.items():
            self.spark.conf.set(k, v)


def _records(spark):
    """Rows that each stage so far has written for a shuffle."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("parts", ["40", "46"])
@pytest.mark.parametrize("limit", [None, 7, 100_000])
def test_blocks_are_dealt_in_rounds(spark, parts, limit):
    """10 and 11 blocks: every pair of them meets once, and no round sends a path more than eight times."""
    rows = _commits(seed=2, paths=150)
    commits = spark.createDataFrame(rows, "hash string, path string").coalesce(1)
    before = _records(spark)
    with _Held(spark, **{"shuffle.partitions": parts}):
        found = [tuple(r) for r in history.cochange(commits, 0, limit).collect()]
    want = _plain(rows, 1, limit)
    assert (sorted(found) if limit is None else found) == (sorted(want) if limit is None else want)
    if limit is None:  # else the first pairs of a round are written too
        assert max(n for k, n in _records(spark).items() if k not in before) <= 8 * 150


def test_hidden_coupling_looks_up_its_pairs_only(spark):
    """A graph of 60,000 nodes and edges beside three pairs: it is not sent around to be joined."""
    nodes = spark.range(60_000).selectExpr("'n' || id AS id", "'p' || id AS file")
    edges = spark.range(60_000).selectExpr("'n' || (id + 10) % 60000 AS source_id", "'n' || id AS target_id")
    before = _records(spark)
    with _Held(spark, **{"autoBroadcastJoinThreshold": "256k"}):
        found = {tuple(r) for r in history.hidden_coupling(_mass(spark), nodes, edges, 3, 3).collect()}
    assert found == {("p0", "p1", 0.5), ("p0", "p100", 0.5)}
    assert sum(n for k, n in _records(spark).items() if k not in before) < 60_000


@pytest.mark.parametrize("dense", [0, 1 / 256, 2])
def test_tiles_by_product_and_by_list(monkeypatch, dense):
    """Small tiles and chunks, all groups by the product, some, or none."""
    for name, value in (("_TILE", 7), ("_CHUNK", 3), ("_LISTED", 11), ("_DENSE", dense)):
        monkeypatch.setattr(pairs, name, value)
    rng = np.random.default_rng(3)
    rows = sorted({(int(g), f"p{i}") for i in range(50) for g in rng.choice([0, 1, 2, 300, 70_000, 1 << 33, *range(10, 40)], rng.integers(1, 25))})
    lists = {}
    for g, p in rows:
        lists.setdefault(p, []).append(g)
    batch = pa.RecordBatch.from_arrays([pa.array(list(lists)), pa.array([v[::-1] for v in lists.values()], pa.list_(pa.int64()))], names=["item", "groups"])
    packed = pa.Table.from_batches(pairs._packed(iter([batch])))
    assert set(packed["bits"].to_pylist()) == {8, 16, 32, 64}
    for halves in (False, True):
        side = [1 + (int(x[1:]) % 2) if halves else 0 for x in packed["item"].to_pylist()]
        table = packed.append_column("side", pa.array(side, pa.int32())).append_column("task", pa.array([0] * len(side), pa.int32()))
        for least, limit in ((4, None), (4, 20), (1, 5)):
            got = [tuple(r.values()) for b in pairs._counted(least, limit)(iter(table.to_batches())) for r in b.to_pylist()]
            want = [x for x in _plain([(str(g), p) for g, p in rows], least) if not halves or int(x[0][1:]) % 2 != int(x[1][1:]) % 2]
            assert sorted(got) == sorted(want if limit is None else want[:limit])
