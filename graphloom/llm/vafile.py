"""Exact top-k search by vector-approximation files.

Two tables are written: the exact vectors, one row each, and their cells, block by block: each component quantised to
``bits`` bits on a grid between the block's smallest and largest value, one byte each. A cell's edges bound the
component, so they bound an inner product from below and above. A search scans the cells only; per query the k-th
highest lower bound leaves the vectors whose upper bound reaches it. Their exact vectors are then read, the highest upper
bounds first: 2 k of them give a k-th best exact score, and what is read after that are the vectors whose upper bound
still reaches it. So the result is exact, ties included, and few exact vectors are read (``search`` tells how many).

How it scales: cell blocks are dealt out to shelves of about ``_SHELF`` bytes, at least as many as there are shuffle
partitions (or blocks); a task holds one shelf's cells and streams all queries past them (the stated query set against
all rows, in blocks). So the cells are shuffled once, and the queries once a shelf. A task emits the candidates of its
shelf; k-th bounds and results are window limits that keep k rows a query and task, and candidates meet their exact
vectors by plain joins on the row number.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows whose id is
null; rows of one id are candidates each, none of them for a query of that id, and such queries share one list; shorter
vectors count as padded with zeros; components whose floor leaves 64 bits and scores that do are cut to 64 bits; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

_CELLS = "block long, ids binary, rows binary, low binary, width binary, cells binary"
_SHELF = 64 << 20
_TILE = 1 << 22
_INT64 = 2**63 - 1


def integer_components(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vectors.isNotNull() & fine, F.transform(vectors, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of int64, padded with zeros to the longest."""
    sizes = np.diff(lists.offsets.to_numpy())
    m = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), sizes)
    m[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return m


class Approximation:
    """The cells of a block of vectors and the bounds that they give."""

    def __init__(self, exact: np.ndarray, bits: int):
        exact = exact.astype(np.int64)
        self.low = exact.min(axis=0, initial=_INT64)
        high = exact.max(axis=0, initial=-_INT64)
        span = (high.view(np.uint64) - self.low.view(np.uint64)).astype(np.uint64)  # wraps to the true difference
        self.width = (span >> np.uint64(bits)) + np.uint64(1)
        self.cells = ((exact.view(np.uint64) - self.low.view(np.uint64)) // self.width).astype(np.uint8)

    @classmethod
    def stored(cls, low: bytes, width: bytes, cells: bytes) -> Approximation:
        self = cls.__new__(cls)
        self.low, self.width = np.frombuffer(low, np.int64), np.frombuffer(width, np.uint64)
        self.cells = np.frombuffer(cells, np.uint8).reshape(-1, len(self.low)) if len(self.low) else np.zeros((len(cells), 0), np.uint8)
        return self

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of queries @ exact.T in float64: exact sums below 2**52, else widened by the rounding."""
        q = queries.astype(np.float64)
        width = self.width.astype(np.float64)
        step = width - 1
        # (low + cell * width) @ q, without a matrix of edges
        base = (q * width) @ self.cells.astype(np.float64).T + (q @ self.low.astype(np.float64))[:, None]
        size = np.abs(q) @ (np.abs(self.low.astype(np.float64)) + 256 * width)
        slack = np.where(size < 2**52, 0.0, size * 2.0**-40)
        return base + (np.minimum(q, 0) @ step - slack)[:, None], base + (np.maximum(q, 0) @ step + slack)[:, None]


def _pack(bits: int):
    def pack(table: pa.Table) -> pa.Table:
        block = Approximation(_matrix(table["v"].combine_chunks()), bits)
        # a block of empty vectors has no cells; a byte a row stands for them
        cells = block.cells if block.cells.shape[1] else np.zeros((table.num_rows, 1), np.uint8)
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (table["id"].to_numpy(), table["row"].to_numpy(), block.low, block.width, cells)]
        return pa.table([pa.array([table["block"][0].as_py()], pa.int64()), *binary], names=["block", "ids", "rows", "low", "width", "cells"])

    return pack


def scan(shelf: list[tuple[np.ndarray, np.ndarray, Approximation]], q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, id, low, high) of the vectors on a shelf whose upper bound reaches the query's k-th lower bound there."""
    ids, rows = (np.concatenate([b[i] for b in shelf]) for i in (0, 1))
    tile = max(1, _TILE // max(1, len(ids)))
    for a in range(0, len(q_ids), tile):
        q = queries[a : a + tile]
        low, high = [], []
        for _, _, block in shelf:
            d = len(block.low)
            own = np.pad(q, ((0, 0), (0, max(0, d - q.shape[1]))))[:, :d]
            for held, x in zip((low, high), block.bounds(own), strict=True):
                held.append(x)
        low, high = np.concatenate(low, axis=1), np.concatenate(high, axis=1)
        other = ids[None, :] != q_ids[a : a + tile, None]
        low[~other] = -np.inf
        n = low.shape[1]
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        which, at = np.nonzero((high >= kth[:, None]) & other)
        yield which + a, rows[at], ids[at], low[which, at], high[which, at]


def _search(k: int):
    """Shelf by shelf: its cells, then the query blocks that are streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shelf = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shelf", "kind", "ids", "rows", "low", "width", "cells"))
            for own, kind, ids, rows, low, width, cells in zip(*columns, strict=True):
                if own != name:
                    name, shelf = own, []
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                if kind == 0:
                    shelf.append((ids, rows, Approximation.stored(low, width, cells)))
                elif shelf:
                    for which, row, id_, lo, hi in scan(shelf, ids, np.frombuffer(cells, np.int64).reshape(len(ids), -1), k):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[which], ids[which], row, id_, lo, hi)], names=["q_row", "query_id", "row", "id", "low", "high"])

    return run


def _pack_queries(table: pa.Table) -> pa.Table:
    m = _matrix(table["v"].combine_chunks())
    m = m if m.shape[1] else np.zeros((len(m), 1), np.int64)
    return pa.table({"ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "rows": pa.array([table["row"].to_numpy().tobytes()], pa.binary()), "cells": pa.array([m.tobytes()], pa.binary())})


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score) of pairs of exact vectors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = _matrix(batch.column("q")), _matrix(batch.column("v"))
        d = min(a.shape[1], b.shape[1])
        a, b = a[:, :d], b[:, :d]
        near = np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64))
        exact = np.einsum("ij,ij->i", a, b)  # wraps where the score leaves 64 bits
        score = np.where(near >= 2.0**63, _INT64, np.where(near < -(2.0**63), -_INT64 - 1, exact))
        yield pa.RecordBatch.from_arrays([batch.column("q_row"), batch.column("query_id"), batch.column("id"), pa.array(score)], names=["q_row", "query_id", "id", "score"])


def _best(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def search(rows: DataFrame, asked: Column, k: int, bits: int, block: int, query_block: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score) with every query's k best and more, the exact reads (q_row, row)). rows: (row, id, v), a table."""
    n, width, n_q = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(asked)).first()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_q // query_block))
    least = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shelves = max(1, least, -(-n * max(1, width) // _SHELF))
    number = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    cells = saved(rows.select(number(blocks).alias("block"), "id", "row", "v").groupBy("block").applyInArrow(_pack(bits), _CELLS), "cells")
    queries = rows.where(asked)
    packed = saved(queries.select(number(q_blocks).alias("block"), "id", "row", "v").groupBy("block").applyInArrow(_pack_queries, "ids binary, rows binary, cells binary"), "queries")
    none = F.lit(None).cast("binary")
    own = cells.select(F.pmod("block", F.lit(shelves)).cast("int").alias("shelf"), F.lit(0).alias("kind"), "ids", "rows", "low", "width", "cells")
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"), F.lit(1).alias("kind"), "ids", "rows", none.alias("low"), none.alias("width"), "cells")
    met = own.unionByName(sent).repartitionById(shelves, F.col("shelf")).sortWithinPartitions("shelf", "kind")
    found = saved(met.mapInArrow(_search(k), "q_row long, query_id long, row long, id long, low double, high double"), "candidates")
    limits = _best(found.select("q_row", "low"), "q_row", [F.col("low").desc()], k).groupBy("q_row").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("limit"))
    left = found.join(limits, "q_row").where((F.col("n") < k) | (F.col("high") >= F.col("limit"))).select("q_row", "query_id", "row", "id", "high")
    left = saved(left.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy(F.col("high").desc(), "row"))), "ranked-candidates")
    vectors, asking = rows.select("row", "v"), queries.select(F.col("row").alias("q_row"), F.col("v").alias("q"))

    def read(some: DataFrame) -> DataFrame:
        return some.join(vectors, "row").join(asking, "q_row").select("q_row", "query_id", "id", "q", "v").mapInArrow(_scores, "q_row long, query_id long, id long, score long")

    first = saved(read(left.where(F.col("rank") <= 2 * k)), "first-reads")
    sure = _best(first, "q_row", [F.col("score").desc()], k).groupBy("q_row").agg(F.min("score").alias("sure"))
    # rounded up a little, as a score beyond 2**53 may be above its double
    more = left.where(F.col("rank") > 2 * k).join(sure, "q_row").where(F.col("high") * (1 + F.signum("high") * 2.0**-50) >= F.col("sure").cast("double"))
    return first.unionByName(read(more)), left.where(F.col("rank") <= 2 * k).select("q_row", "row").unionByName(more.select("q_row", "row"))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, bits: int = 6, block: int = 8192, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products with all rows but its own, ties to the smaller id.

    queries: a condition on the id column ``id`` that says which rows ask. bits: at most 8.
    """
    named = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), integer_components(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    found, _ = search(saved(named, "vectors"), queries, k, bits, block, query_block)
    best = _best(found, "query_id", [F.col("score").desc(), F.col("id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
