"""SimHash near-dedup by a binary trie self-join.

Fingerprints: the text is lower-cased (A-Z), its words are the runs of anything but ASCII white space, its shingles are
``width`` words joined by a space, repeats included (fewer words: the whole sequence; none: fingerprint zero). A bit is
set if more than half the shingles' XXH64 (seed 42) have it. Fingerprints that differ in at most ``max_bits`` bits are
linked; a document's component is named after the smallest id that can be reached.

How the join scales. Documents with one fingerprint are one vertex, so exact copies cost a map-side combined count and
no pair. Two fingerprints within ``max_bits`` = 4 bits agree on at least one of five blocks of bits, so each fingerprint
goes into five tries, one for each block that is put first: the block's value is the root that owns a trie, the bits
behind it are branched on. The self-join of a trie starts from the pair (root, root) and traverses pairs of nodes
together: differing bits are accumulated along the way and a pair is pruned as soon as they exceed the budget; a pair
whose leaves already hang together is pruned too, because only reachability is asked for. So a trie emits at most one
link a fingerprint, not the pairs of a group.

A trie of more than ``most`` fingerprints is split before it is joined: its free bits are cut in six blocks, of which
two must agree, and these are put first as well. Fingerprints are distinct, so a trie with at most 13 free bits holds at
most 8192 of them: at most four splits bound every trie, whatever the size of a group, and no pair is lost on the way.
The number of tasks follows from the number of fingerprints.

Links then shrink to stars by alternating large-star and small-star steps until nothing changes, each step written to
the shared folder. Where one key holds many rows (a hub, the fingerprint of many copies), its one row of the other side
is sent to the workers: keys with over 1/2000 of all rows, so never more than 2000 of them.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows
stay rows and share a component; a null id gets the component of its fingerprint's smallest other id; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, field_type, forget, met, saved, texts

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_CHUNK = 1 << 18
_PART = 500_000  # rows for each task that joins tries
_TOGETHER = 1 << 15
_FEW_BITS = 13  # a root with no more free bits holds 8192 fingerprints at most and isn't split


def fingerprint(data: bytes, width: int = 4) -> int:
    words = data.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    n = len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(norm, 42)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(norm[s:e], 42) for s, e in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])
    m = n - width + 1
    table = np.frombuffer(hashes, np.uint8).reshape(m, 8)  # big-endian digests
    ones = np.concatenate([np.bincount(table[:, 7 - k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return sum(1 << b for b in np.flatnonzero(2 * ones > m).tolist())


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""
    schema = T.StructType([T.StructField(id_col, field_type(docs, id_col)), T.StructField("fp", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t or b"", width) for t in texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return arrow_map(docs.select(id_col, text_col), work, schema, text_col)


def _blocks(free: list[int], k: int = 6) -> list[list[int]]:
    cuts = [round(i * len(free) / k) for i in range(k + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _roots(max_bits: int, free_mask: int = -1, agree: int = 1) -> list[int]:
    """Masks of ``agree`` blocks of bits: any two numbers within max_bits on the free bits agree on one mask at least."""
    free = [b for b in range(64) if free_mask >> b & 1]
    return [_mask(sum(some, [])) for some in itertools.combinations(_blocks(free, max_bits + agree), agree)]


def _children(a0, a1, am, b0, b1, bm, diff, max_bits) -> tuple[np.ndarray, ...]:
    """The pairs of children of pairs of nodes within the budget; am, bm: where the children for a set bit begin."""
    same = (a0 == b0) & (a1 == b1)
    parts = []
    for p0, p1, q0, q1, extra, only in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
        ok = (p1 > p0) & (q1 > q0) & (diff + extra <= max_bits)
        if only is not None:
            ok &= only
        parts.append((p0[ok], p1[ok], q0[ok], q1[ok]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def trie_links(fps: np.ndarray, root: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint that it hangs on) of a self-join of binary tries.

    fps: uint64, root: an id of each one's trie; only fingerprints of one trie are compared. The leaves of a node are a
    range of the sorted fingerprints, so a node is (from, to); ways without a branch are stepped over at once.
    """
    order = np.lexsort((fps, root))
    fps, root = fps[order], root[order]
    n = len(fps)
    parent = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            parent[x] = parent[up]
            x = parent[up]

    def union(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = find(a), find(b)
            other = a != b
            a, b = a[other], b[other]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    if n > 1:  # neighbours in trie order first: dense groups hang together at once
        near = np.flatnonzero((root[1:] == root[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= max_bits))
        union(near, near + 1)
    begins = np.flatnonzero(np.r_[True, root[1:] != root[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[begins[1:], n]
    wide = ends - begins > 1
    # frontier: pairs of nodes (a0, a1) x (b0, b1)
    stack = [(begins[wide], ends[wide], begins[wide], ends[wide])]

    def middle(lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where the leaves with this bit begin; leaves of a node agree on all higher bits."""
        lo, hi = lo.copy(), hi.copy()
        one = np.uint64(1)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            isset = (fps[np.minimum(mid, n - 1)] >> bit.astype(np.uint64) & one).astype(bool)
            hi = np.where(open_ & isset, mid, hi)
            lo = np.where(open_ & ~isset, mid + 1, lo)

    while stack:
        pairs = stack.pop()
        if len(pairs[0]) > _CHUNK:
            half = len(pairs[0]) // 2
            stack += [tuple(x[:half] for x in pairs), tuple(x[half:] for x in pairs)]
            continue
        a0, a1, b0, b1 = pairs
        # down to the next bit on which leaves of a node differ; the bits above it that differ between the two are the cost
        below = (fps[a0] ^ fps[a1 - 1]) | (fps[b0] ^ fps[b1 - 1])
        for shift in (1, 2, 4, 8, 16, 32):
            below |= below >> np.uint64(shift)
        diff = np.bitwise_count((fps[a0] ^ fps[b0]) & ~below).astype(np.int64)
        ok = diff <= max_bits
        leaf = ok & (below == 0) & (a0 < b0)
        union(a0[leaf], b0[leaf])
        ok &= below > 0
        a0, a1, b0, b1, below, diff = (x[ok] for x in (a0, a1, b0, b1, below, diff))
        if not len(a0):
            continue
        # prune pairs whose leaves all hang together already
        label = find(np.arange(n))
        changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        apart = (changes[a1 - 1] != changes[a0]) | (changes[b1 - 1] != changes[b0]) | (label[a0] != label[b0])
        a0, a1, b0, b1, below, diff = (x[apart] for x in (a0, a1, b0, b1, below, diff))
        if len(a0):
            bit = np.bitwise_count(below).astype(np.int64) - 1
            stack.append(_children(a0, a1, middle(a0, a1, bit), b0, b1, middle(b0, b1, bit), diff, max_bits))
    top = find(np.arange(n))
    linked = top != np.arange(n)
    return fps[linked], fps[top[linked]]


class _Roots:
    """(fp, mask) becomes (fp, finer mask) once for each way to choose the blocks of free bits that must agree."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits

    def __call__(self, batches):
        finer: dict[int, np.ndarray] = {}
        for b in batches:
            fp, mask = b.column("fp").to_numpy(), b.column("mask").to_numpy()
            for m in np.unique(mask).tolist():
                if m not in finer:
                    finer[m] = np.array([m | f for f in _roots(self.max_bits, ~m, 2 if m else 1)], np.int64)
                own = fp[mask == m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(finer[m]))), pa.array(np.tile(finer[m], len(own)))], names=["fp", "mask"])


def links(distinct: DataFrame, max_bits: int = 4, most: int = 8192) -> DataFrame:
    """(src, dst) between distinct fingerprints ``fp``: enough of them to reach whatever can be reached."""
    spark = distinct.sparkSession
    keyed_schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("mask", T.LongType())])
    link_schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = distinct.select("fp", F.lit(0).cast("bigint").alias("mask"))
    out: list[DataFrame] = []
    while True:
        key = F.col("fp").bitwiseAND(F.col("mask"))
        todo = saved(todo.mapInArrow(_Roots(max_bits), keyed_schema).withColumn("key", key), "trie-roots")
        hot = todo.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & (F.bit_count("mask") < 64 - _FEW_BITS)).select("mask", "key")
        hot = saved(hot, "hot-roots")
        last = hot.isEmpty()
        own = todo if last else todo.join(hot, ["mask", "key"], "left_anti")
        parts = max(least, -(-own.count() // _PART))
        out.append(own.select("fp", "mask", "key").repartition(parts, "mask", "key").mapInArrow(_Join(max_bits), link_schema))
        if last:
            break
        todo = todo.join(hot, ["mask", "key"], "left_semi").select("fp", "mask")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


class _Join:
    """Joins the tries of a partition."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits

    def __call__(self, batches):
        got = [(b.column("fp").to_numpy(), b.column("mask").to_numpy(), b.column("key").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        fp, mask, key = (np.concatenate(x) for x in zip(*got, strict=True))
        _, root = np.unique(np.stack([mask, key]), axis=1, return_inverse=True)
        root = root.ravel()
        order = np.argsort(root, kind="stable")
        root = root[order]
        fp = fp[order].view(np.uint64)
        begins = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        # whole tries, some at a time
        cuts = begins[np.flatnonzero(np.diff(begins // _TOGETHER, prepend=-1))]
        for a, b in zip(cuts, [*cuts[1:], len(root)], strict=True):
            src, dst = trie_links(fp[a:b], root[a:b], self.max_bits)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (src, dst) can reach, by large-star and small-star."""
    edges = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")

    def mark(df: DataFrame) -> tuple:
        # a sum that may overflow is kept within range by taking each hash's remainder
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = saved(met(both, least, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: u > v always holds here
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = met(large, low, "u", before[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, saved(small, "stars")
        forget(last, least, large, low)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components(prints: DataFrame, max_bits: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """((fp, root, n) of every fingerprint with its n rows, (root, component_id, n): the smallest id of each component with its n fingerprints)."""
    distinct = saved(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = saved(named, "roots")
    return named.select("fp", "root", "n"), saved(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest-ids")


def group(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id."""
    prints = saved(fingerprints(docs, width, id_col, text_col), "fingerprints")
    named, least = _components(prints, max_bits, id_col)
    rows, fps = named.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ids = met(named.select("fp", "root", F.col("n").alias("rows")), least, "root", fps).select("fp", "component_id", F.col("rows").alias("n"))
    return met(prints, saved(ids, "component-ids"), "fp", rows).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one row of each component stays: one with the smallest id.

    Null ids come last; of rows with one id the text's hash decides, of rows with one id and text the other columns' hash.
    """
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")).alias("__gl_doc"), F.col(text_col).alias("text"))
    prints = saved(fingerprints(rows, width, "__gl_doc", "text"), "fingerprints")
    kept = _components(prints, max_bits, "__gl_doc")[1].select(F.col("component_id.key").alias("__gl_key"))
    found = docs.withColumn("__gl_key", key).join(kept, "__gl_key", "left_semi")
    repeat = F.row_number().over(Window.partitionBy("__gl_key").orderBy(F.xxhash64(*docs.columns)))
    return found.withColumn("__gl_repeat", repeat).where("__gl_repeat = 1").select(*docs.columns)
