"""Vector-approximation files: large components, repeated ids, what is read."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import vafile
from graphloom.llm.common import saved


def brute(rows, asks, k, scale=64):
    """Per query id: the best of the rows with other ids, once for each row that asks."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    out = {}
    for i, q in whole:
        if asks(i):
            out.setdefault(i, []).extend((-sum(x * y for x, y in zip(q, v, strict=False)), j) for j, v in whole if j != i)
    return {i: [(j, -s) for s, j in sorted(found)[:k]] for i, found in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_components_beyond_32_bits(spark):
    r = random.Random(1)
    for top in (1e6, 1e9, 1e14):
        rows = [(i, [r.uniform(-top, top) if r.random() < 0.2 else r.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
        rows = [(i, [x if abs(x) < 1e7 or i % 4 else x / top for x in v]) for i, v in rows]  # queries are small: scores fit 64 bits
        got = found(vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 4 == 0, 5, block=9))
        assert got == brute(rows, lambda i: i % 4 == 0, 5), top
    one = spark.createDataFrame([(0, [1.0]), (1, [1e9])], "vec_id long, embedding array<double>")
    assert found(vafile.top_k(one, F.col("id") == 0)) == {0: [(1, 4_096_000_000_000)]}


def test_rows_of_one_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [2.0, 0.5]), (7, [0.0, 4.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 3, 20):
        assert found(vafile.top_k(df, F.col("id") % 5 == 0, k, block=2, query_block=2)) == brute(rows, lambda i: i % 5 == 0, k)


def test_many_ties_and_equal_vectors(spark):
    rows = [(i, [0.5, 0.5] if i % 3 else [1.0, -1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(vafile.top_k(df, F.col("id") % 40 == 0, 7, bits=2, block=16)) == brute(rows, lambda i: i % 40 == 0, 7)


def test_few_exact_vectors_are_read(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 0.125, 64).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    named = saved(df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), vafile.integer_components(F.col("embedding"), 64).alias("v")), "vectors")
    best, reads = vafile.search(named, F.col("id") % 400 == 0, 10, 6, 512, 4)
    assert reads.count() == best.count() < 10 * 4000 * 0.03
    assert reads.count() == reads.distinct().count()


def test_cells_are_a_byte_a_component_and_bound_wide_ranges():
    r = np.random.default_rng(3)
    for top in (1, 300, 1 << 40, 1 << 62):
        exact, q = r.integers(-top, top, (50, 6)), r.integers(-3, 4, (9, 6))
        for bits in (1, 6, 8):
            own = vafile.Approximation(exact, bits)
            assert own.cells.dtype == np.uint8 and own.cells.max() < 1 << bits
            low, high = own.bounds(q)
            true = np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in exact] for a in q], object)
            assert (low <= true).all() and (true <= high).all()
