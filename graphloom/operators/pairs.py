"""Pairs of items that share many groups, such as paths that change in the same commits.

A group's pairs are quadratic in its items, so they are never rows. Groups are numbered, each item has one row with the
numbers of its groups, packed as steps, and items are dealt to blocks by a hash of their name. A task holds one block or
two and counts in tiles of ``_TILE`` by ``_TILE`` items: groups that many of the tile's items share by a matrix product
of zeros and ones, all others by listing their pairs within the tile.

Every pair is counted or cannot count. Items come in order of how many groups they share with the other block; where a
limit is given, items with fewer than the task's limit-th pair so far are stepped over, and the limit-th pair within the
blocks, which come first, says which items are dealt to other blocks at all. Ties go to the smaller names, in bytes.

How it scales: items' rows are shuffled once, and those that are still in question once a block, in rounds: a round sends
each at most ``2 * _APART`` times, however many blocks there are, and knows the limit-th pair of the rounds before it. The
number of blocks follows the number of shuffle partitions, for as many tasks, and the number of rows, so that two blocks
fit in memory. Where neither the limit nor few shared groups leave anything out, counting is quadratic in the items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import forget, written

_TILE = 1024
_CHUNK = 2048
_LISTED = 1 << 22
#: A group with more than this part of a tile's cells is cheaper in the product than in the list.
_DENSE = 1 / 256
_BUCKETS = 256
#: Numbers of a block, about: some hundred MB for two of them and what is made of them.
_BLOCK = 1 << 22
#: Distances between blocks that one round deals out: each row is sent at most twice as often at once.
_APART = 4


def shared(rows: DataFrame, group: str, item: str, least: int, limit: int | None = None) -> DataFrame:
    """(a, b, n): pairs of items a < b with n >= least groups in common, the ``limit`` first by (-n, a, b) or all."""
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("item")).where("g IS NOT NULL AND item IS NOT NULL")
    least, keep = max(least, 1), None if limit is None else max(limit, 1)
    bucket = F.pmod(F.xxhash64("g"), F.lit(_BUCKETS))
    met = own.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("g", bucket.alias("bucket"))
    number = (F.row_number().over(Window.partitionBy("bucket").orderBy("g")).cast("long") - 1) * _BUCKETS + F.col("bucket")
    held = own.join(met.select("g", number.alias("no")), "g").groupBy("item").agg(F.collect_set("no").alias("groups")).where(F.size("groups") >= least)
    packed = written(held.mapInArrow(_packed, "item string, n long, bits int, groups binary"), "pairs")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(math.ceil(math.sqrt(2 * tasks + 0.25) + 0.5), -(-entries // _BLOCK))
    block, kind = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"), "a string, b string, n long"
    found = packed.select(block.alias("task"), F.lit(0).alias("side"), "item", "bits", "groups").repartitionById(blocks, F.col("task")).mapInArrow(_counted(least, keep), kind)
    rounds = [range(d, min(d + _APART, blocks // 2 + 1)) for d in range(1, blocks // 2 + 1, _APART)]
    floor, first = least, None
    for apart in rounds:
        if keep is not None:
            last, first = first, written(_first(found, keep), "pairs-first")
            if last is not None:
                forget(last)
            found, top = first, first.agg(F.count(F.lit(1)), F.min("n")).first()
            floor = top[1] if top[0] == keep else least
        dealt = _dealt(packed.where(F.col("n") >= floor).withColumn("block", block), blocks, apart).mapInArrow(_counted(floor, keep), kind)
        found = found.unionByName(dealt if keep is not None or len(rounds) == 1 else written(dealt, "pairs-round"))
    return found if limit is None else _first(found, limit)


def _first(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.col("n").desc(), "a", "b").limit(limit)


def _dealt(packed: DataFrame, blocks: int, apart: range) -> DataFrame:
    """Rows by pair of blocks that are so far apart, in a circle: twice for each distance, once for the widest of an even number."""
    steps = sorted({s % blocks for d in apart for s in (d, -d)})
    each = packed.withColumn("step", F.explode(F.array(*(F.lit(s) for s in steps))))
    other = (F.col("block") + F.col("step")) % blocks
    start = F.when(F.col("step") * 2 < blocks, F.col("block")).when(F.col("step") * 2 > blocks, other).otherwise(F.least("block", other))
    task = (F.least("step", blocks - F.col("step")) - apart.start) * blocks + start
    return each.select(task.cast("int").alias("task"), F.when(F.col("block") == start, 1).otherwise(2).alias("side"), "item", "bits", "groups").repartitionById(blocks * len(apart), F.col("task"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each list as steps between its sorted numbers, all in the fewest bits of 8, 16, 32 or 64."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, flat = _lists(batch.column("groups"))
        row = np.repeat(np.arange(len(sizes)), sizes)
        step = flat[np.lexsort((flat, row))]
        first = np.cumsum(sizes) - sizes  # no list is empty
        step[1:] -= step[:-1].copy()
        step[first] = np.minimum.reduceat(flat, first)
        most = np.maximum.reduceat(step, first)
        bits = np.select([most < 1 << w for w in (8, 16, 32)], [8, 16, 32], 64)
        for w in np.unique(bits):
            own = bits == w
            data = step[own[row]].astype(f"u{w // 8}").tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes[own] * (w // 8))]).astype(np.int64)
            groups = pa.Array.from_buffers(pa.large_binary(), int(own.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item").filter(pa.array(own)), pa.array(sizes[own]), pa.array(np.full(len(groups), w, np.int32)), groups], names=["item", "n", "bits", "groups"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy()


def _unpacked(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, sizes of their lists, all their numbers) for each number of bits."""
    bits = table["bits"].to_numpy()
    for w in np.unique(bits):
        own = table.filter(pa.array(bits == w))
        sizes = pc.binary_length(own["groups"]).to_numpy().astype(np.int64) // (w // 8)
        flat = np.concatenate([_steps(c, int(w)) for c in own["groups"].chunks if len(c)]).cumsum()
        first = np.cumsum(sizes) - sizes
        yield own, sizes, flat - np.repeat(np.where(first > 0, flat[first - 1], 0), sizes)


def _steps(column: pa.Array, bits: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(f"u{bits // 8}").astype(np.int64)


def _counted(least: int, limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        task = table["task"].to_numpy()
        for t in np.unique(task):
            yield from _task(table.filter(pa.array(task == t)), least, limit)

    return run


class _Side:
    """Items in order of falling numbers of groups; ``flat`` has their groups, item by item, from ``start`` on."""

    def __init__(self, rank: np.ndarray, sizes: np.ndarray, flat: np.ndarray, kept: np.ndarray, least: int):
        row = np.repeat(np.arange(len(sizes)), sizes)
        row, flat = row[kept[flat]], flat[kept[flat]]
        n = np.bincount(row, minlength=len(sizes))
        order = np.argsort(-n, kind="stable")
        order = order[n[order] >= least]
        place = np.full(len(sizes), -1)
        place[order] = np.arange(len(order))
        row = place[row]
        row, flat = row[row >= 0], flat[row >= 0]
        self.flat, self.n, self.rank = flat[np.argsort(row, kind="stable")], n[order], rank[order]
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def reach(self, least: int) -> int:
        """How many items have that many groups."""
        return int(np.searchsorted(-self.n, -least, side="right"))

    def slice(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(item from 0 on, group) of the items first to last."""
        return np.repeat(np.arange(last - first), self.n[first:last]), self.flat[self.start[first] : self.start[last]]


def _task(table: pa.Table, least: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    own, sizes, flat = zip(*_unpacked(table))
    table, sizes = pa.concat_tables(own), np.concatenate(sizes)
    groups, flat = np.unique(np.concatenate(flat), return_inverse=True)
    names = table["item"].cast(pa.binary()).combine_chunks()
    side, row = table["side"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    twice = not side.any()
    if twice:
        one = both = _Side(rank, sizes, flat, np.bincount(flat, minlength=len(groups)) > 1, least)
    else:
        each = [(side == s, flat[side[row] == s]) for s in (1, 2)]
        kept = np.logical_and(*(np.bincount(f, minlength=len(groups)) > 0 for _, f in each))
        one, both = (_Side(rank[m], sizes[m], f, kept, least) for m, f in each)
    best = _Best(least, limit)
    for a, b, n in _tiles(one, both, len(groups), twice, best):
        if limit is None and len(n):
            yield _rows(names, order, a, b, n)
    if limit is not None:
        yield _rows(names, order, best.a, best.b, best.n)


def _rows(names: pa.Array, order: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    text = [names.take(pa.array(order[x])).cast(pa.string()) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*text, pa.array(n, pa.int64())], names=["a", "b", "n"])


class _Best:
    """The ``limit`` first pairs so far, or no more than the bound where there is no limit."""

    def __init__(self, least: int, limit: int | None):
        self.least, self.limit = least, limit
        self.a, self.b, self.n = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        a, b, n = (np.concatenate(x) for x in ((self.a, a), (self.b, b), (self.n, n)))
        if len(n) > self.limit:
            kth = np.partition(n, len(n) - self.limit)[len(n) - self.limit]
            more, ties = np.flatnonzero(n > kth), np.flatnonzero(n == kth)
            free = self.limit - len(more)
            if len(ties) > free:
                key = a[ties] * (int(b.max()) + 1) + b[ties]
                ties = ties[np.argpartition(key, free - 1)[:free]]
            own = np.concatenate([more, ties])
            a, b, n = a[own], b[own], n[own]
        if len(n) == self.limit:
            self.least = int(n.min())
        self.a, self.b, self.n = a, b, n


def _tiles(one: _Side, both: _Side, groups: int, twice: bool, best: _Best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) of each tile's pairs that reach the bound, a and b as ranks, a < b; best gets them where it has a limit."""
    local = np.full(groups, -1)
    first = 0
    while first < one.reach(best.least):
        last = min(first + _TILE, one.reach(best.least))
        row, group = one.slice(first, last)
        has, group = np.unique(group, return_inverse=True)
        local[has] = np.arange(len(has))
        at = first if twice else 0
        while at < both.reach(best.least):
            end = min(at + _TILE, both.reach(best.least))
            column, other = both.slice(at, end)
            other = local[other]
            n = _tile(row, group, last - first, column[other >= 0], other[other >= 0], end - at, len(has))
            if twice and at == first:
                n = np.triu(n, 1)
            x, y = np.nonzero(n >= best.least)
            n, x, y = n[x, y], one.rank[first + x], both.rank[at + y]
            a, b = np.minimum(x, y), np.maximum(x, y)
            if best.limit is not None:
                best.add(a, b, n)
            yield a, b, n
            at = end
        local[has] = -1
        first = last


def _tile(row: np.ndarray, group: np.ndarray, rows: int, column: np.ndarray, other: np.ndarray, columns: int, groups: int) -> np.ndarray:
    """How many groups each row shares with each column."""
    out = np.zeros((rows, columns), np.int64)
    mine, theirs = np.bincount(group, minlength=groups), np.bincount(other, minlength=groups)
    dense = mine * theirs > rows * columns * _DENSE
    number = np.cumsum(dense) - 1
    heavy = int(dense.sum())
    in_row, in_column = dense[group], dense[other]
    for c in range(0, heavy, _CHUNK):
        wide = min(_CHUNK, heavy - c)
        pair = []
        for size, x, g, own in ((rows, row, group, in_row), (columns, column, other, in_column)):
            k = number[g] - c
            own = own & (k >= 0) & (k < wide)
            m = np.zeros((size, wide), np.float32)
            m[x[own], k[own]] = 1
            pair.append(m)
        out += (pair[0] @ pair[1].T).astype(np.int64)  # sums of at most _CHUNK ones are exact
    row, group, column, other = row[~in_row], group[~in_row], column[~in_column], other[~in_column]
    column = column[np.argsort(other, kind="stable")]
    count = np.where(dense, 0, theirs)
    start = np.cumsum(count) - count
    ends = np.cumsum(count[group])
    a = 0
    while a < len(row):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + _LISTED, side="right")))
        each = count[group[a:b]]
        total = int(ends[b - 1]) - done
        if total:
            k = np.arange(total) + np.repeat(start[group[a:b]] - (np.cumsum(each) - each), each)
            out += np.bincount(np.repeat(row[a:b], each) * columns + column[k], minlength=rows * columns).reshape(rows, columns)
        a = b
    return out
