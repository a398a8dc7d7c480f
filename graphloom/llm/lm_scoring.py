"""Cross-entropy difference: a target and a background bigram model over one vocabulary score every document.

Words are lower-cased (A-Z) runs of anything but ASCII white space. All documents are counted for the background model,
those that are marked for the target model. A document is its words and an end, read after a beginning. Both models are
matched: the same vocabulary with the same base frequencies g(w) (each word's share of all documents' events), the same
two orders, the same prior weight m, and for each the counts u, c of its own documents (N events in all):

    p1(w) = (u(w) + m g(w)) / (N + m)        p(w | v) = (c(v w) + m p1(w)) / (c(v) + m)

Every word and every bigram that occurs counts, at every size. Each document is left out of the counts that score it
(u, c and N, in both models; in the target model if it is marked), so no model has seen what it scores. A document's
losses are the means of -log p over its words and its end; the score is loss_target - loss_background: the lower, the
closer to the target.

How it scales. Counts are asked for by batches of documents and answered by hash ranges:
1. A batch counts its words and bigrams and sends each different one once, as a 64-bit hash, to the part that owns the
   hash's range: sorted, as differences, with the batch's own counts. The batch itself travels as numbers of its words.
2. A part sums the counts of each hash over all batches and answers every batch in the order in which it asked.
3. A batch, met by its answers, computes its documents' losses.
A hot word or bigram is one entry a batch, so no part grows with it; a part has about ``_PART`` events, a batch
``_BATCH`` bytes of text, and nothing is gathered but four totals. Marks are sent to the scan if there are at most
``_SENT`` of them; beyond, they are joined by a shuffle and the marked texts are written once.

Defined results: null, empty and blank texts have no words, null losses and score 0, and count for no model; documents
with a null id are background only; repeated rows are counted and scored one by one (and are each other's evidence);
other columns are not read; an empty table gives an empty result. Without target documents the target model is g.
docs has to give the same rows in the same order when a lost part is read again, as tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, pieces, saved

_BATCH = 8 << 20
_PART = 4_000_000
_SENT = 1 << 20
_BODY = -1
_EVENTS = r"[^\x20\x09-\x0D]+"
_BOUNDARIES = np.array([1, 2], np.uint64)  # the end, the beginning
_M1, _M2, _33, _29, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(33), np.uint64(29), np.uint64(32)
_ZSTD = pa.Codec("zstd")


def _pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of as many bytes as the largest needs."""
    steps = np.diff(hashes)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + hashes[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_hashes(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, : data[0]] = steps
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), wide.view(np.uint64).ravel()]), dtype=np.uint64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of 0 or more, by planes of bytes, compressed."""
    out = [np.array([len(columns), *map(len, columns)], np.int64).tobytes()]
    for x in columns:
        x = x.astype(np.int64)
        width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        out.append(bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    data = b"".join(out)
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    data = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    count = int.from_bytes(data[:8], "little")
    sizes = np.frombuffer(data, np.int64, count, 8).tolist()
    at, columns = 8 * (count + 1), []
    for n in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : data[at]] = np.frombuffer(data, np.uint8, n * data[at], at + 1).reshape(data[at], n).T
        at += 1 + n * data[at]
        columns.append(wide.view(np.int64).ravel())
    return columns


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each different word, commonest first; each word's number; how many words each text has)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string(), safe=False), "")))
    coded = split.flatten().dictionary_encode()
    kinds = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, kinds), np.uint64, len(kinds))
    words = coded.indices.to_numpy().astype(np.int64)
    times = np.bincount(words, minlength=len(kinds))
    blank = kinds.index(b"") if b"" in kinds else -1  # what is before a text's first white space or behind its last
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    if blank >= 0:
        keep = words != blank
        offsets, words, times[blank] = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[offsets], words[keep], 0
    order = np.argsort(-times, kind="stable")[: len(kinds) - (blank >= 0)]
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(order))
    return hashes[order], place[words], np.diff(offsets)


class _Grams:
    """A batch's events: each word after the one before it, and each text's end."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        kinds = len(hashes)
        full = lengths > 0
        ends = np.cumsum(lengths)[full]
        self.doc = np.repeat(np.arange(len(lengths)), np.where(full, lengths + 1, 0))
        self.word = np.insert(words, ends, kinds)
        self.before = np.insert(words, ends - lengths[full], kinds + 1)
        pairs, self.pair = np.unique(self.before * (kinds + 2) + self.word, return_inverse=True)
        every = np.concatenate([hashes, _BOUNDARIES])
        mixed = every[pairs // (kinds + 2)] * _M1 + every[pairs % (kinds + 2)]
        mixed = (mixed ^ mixed >> _33) * _M2
        self.kinds, self.pairs = kinds, len(pairs)
        codes = np.concatenate([hashes, mixed ^ mixed >> _29])  # of words, then of bigrams
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """How often each code occurs in the batch, events counted by weight."""
        words = np.bincount(self.word, weight, minlength=self.kinds + 2)[: self.kinds]
        return np.concatenate([words, np.bincount(self.pair, weight, minlength=self.pairs)])[self.order].astype(np.int64)

    def own(self, of: np.ndarray, kinds: int) -> np.ndarray:
        """How often each event's word or bigram occurs in its document."""
        _, at, n = np.unique(self.doc * kinds + of, return_inverse=True, return_counts=True)
        return n[at]


def _row_type(id_type: T.DataType) -> T.StructType:
    fields = ("to", T.IntegerType()), ("batch", T.LongType()), ("part", T.LongType()), ("codes", T.BinaryType()), ("counts", T.BinaryType()), ("ids", T.ArrayType(id_type))
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _rows(rows: list[tuple], ids: list[pa.Array | None], like: pa.DataType) -> pa.RecordBatch:
    to, batch, part, codes, counts = (list(c) for c in zip(*rows, strict=True))
    sizes = [0 if i is None else len(i) for i in ids]
    flat = pa.concat_arrays([i for i in ids if i is not None]) if any(i is not None for i in ids) else pa.array([], like)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
    arrays = [pa.array(to, pa.int32()), pa.array(batch, pa.int64()), pa.array(part, pa.int64()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary()), lists]
    return pa.RecordBatch.from_arrays(arrays, names=["to", "batch", "part", "codes", "counts", "ids"])


def _ask(parts: int):
    """Of each batch: its body, and what it asks of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(pieces(batches, "text", _BATCH)):
            ids = batch.column("id")
            hashes, words, lengths = _read(batch.column("text"))
            marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
            name, home = task << 32 | number, (task + 7919 * number) % parts
            yield _rows([(home, name, _BODY, hashes.tobytes(), _pack(words, lengths, marks))], [ids], ids.type)
            if not len(words):
                continue
            grams = _Grams(hashes, words, lengths)
            every, target = grams.counts(np.ones(len(grams.doc))), grams.counts(marks[grams.doc])
            part = ((grams.codes >> _32) * np.uint64(parts) >> _32).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            asked = [(int(part[a]), name, home, _pack_hashes(grams.codes[a:b]), _pack(every[a:b], target[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            for a in range(0, len(asked), 64):
                yield _rows(asked[a : a + 64], [None] * len(asked[a : a + 64]), ids.type)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a part's counts for every batch, in the order in which it asked; bodies pass through."""
    asked, codes, every, target, like, part = [], [], [], [], None, 0
    for batch in batches:
        like = batch.schema.field("ids").type.value_type
        body = pc.equal(batch.column("part"), _BODY)
        if pc.any(body).as_py():
            yield pa.RecordBatch.from_arrays(batch.filter(body).columns, names=batch.schema.names)
        for to, name, home, packed, counts in zip(*(batch.filter(pc.invert(body)).column(c).to_pylist() for c in ("to", "batch", "part", "codes", "counts")), strict=True):
            part = to
            asked.append((home, name))
            codes.append(_unpack_hashes(packed))
            b, t = _unpack(counts)
            every.append(b)
            target.append(t)
    if not asked:
        return
    sizes = np.cumsum([0, *map(len, codes)]).tolist()
    _, at = np.unique(np.concatenate(codes), return_inverse=True)
    codes.clear()
    sums = [np.bincount(at, np.concatenate(x)).astype(np.int64) for x in (every, target)]
    every.clear()
    target.clear()
    for k, (home, name) in enumerate(asked):
        own = at[sizes[k] : sizes[k + 1]]
        yield _rows([(home, name, part, b"", _pack(*(s[own] for s in sums)))], [None], like)


def _losses(grams: _Grams, counts: tuple[np.ndarray, np.ndarray], marks: np.ndarray, lengths: np.ndarray, totals: tuple, prior: float) -> list[np.ndarray]:
    """The target's and the background's loss of every event. totals: events and documents, of all and of the target."""
    n_all, d_all, n_target, d_target = totals
    word, pair = grams.own(grams.word, grams.kinds + 2), grams.own(grams.pair, grams.pairs)
    before = np.concatenate([np.ones(1, np.int64), word[:-1]])  # the word before is the last event's word
    before[grams.before == grams.kinds + 1] = 1
    length, mark = (lengths + 1)[grams.doc], marks[grams.doc]

    def seen(sums: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
        by_code = np.empty(len(sums), np.int64)
        by_code[grams.order] = sums
        return np.concatenate([by_code[: grams.kinds], [documents, documents]]), by_code[grams.kinds :]

    every, _ = seen(counts[0], d_all)
    base = every[grams.word] / max(1, n_all)
    out = []
    for sums, events, documents, in_it in ((counts[1], n_target, d_target, mark), (counts[0], n_all, d_all, np.ones(len(mark), np.int64))):
        words, pairs = seen(sums, documents)
        p1 = (words[grams.word] - in_it * word + prior * base) / (events - in_it * length + prior)
        out.append(np.log(words[grams.before] - in_it * before + prior) - np.log(pairs[grams.pair] - in_it * pair + prior * p1))
    return out


def _finish(totals: tuple, prior: float, names: list[str]):
    """Each batch's documents with their losses; rows come by batch, its body first, then its answers by part."""

    def done(ids: pa.Array, body: tuple[bytes, bytes], answers: list[bytes]) -> pa.RecordBatch:
        words, lengths, marks = _unpack(body[1])
        grams = _Grams(np.frombuffer(body[0], np.uint64), words, lengths)
        found = [_unpack(a) for a in answers] or [[np.zeros(0, np.int64)] * 2]
        counts = tuple(np.concatenate(x) for x in zip(*found, strict=True))
        if len(counts[0]) != len(grams.codes):
            raise AssertionError("a batch lacks answers")
        sums = [np.bincount(grams.doc, x, minlength=len(lengths)) for x in _losses(grams, counts, marks, lengths, totals, prior)]
        target, background = (pa.array(x / (lengths + 1), mask=lengths == 0) for x in sums)
        score = pc.fill_null(pc.subtract(target, background), 0.0)
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths), target, background, score], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = ids = body = None
        answers: list[bytes] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("batch", "part", "codes", "counts"))
            for row, (own, part, codes, counts) in enumerate(zip(*columns, strict=True)):
                if part != _BODY:
                    if own != name:
                        raise AssertionError("answers without a batch")
                    answers.append(counts)
                    continue
                if name is not None:
                    yield done(ids, body, answers)
                name, ids, body, answers = own, batch.column("ids")[row].values, (codes, counts), []
        if name is not None:
            yield done(ids, body, answers)

    return run


def score(docs: DataFrame, target: DataFrame, prior: float = 1000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, loss_target, loss_background, score) of every document. target: the ids of the target's documents."""
    marks = target.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("mark", F.lit(True))
    few = marks.limit(_SENT + 1).count() <= _SENT
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = named.join(F.broadcast(marks) if few else marks.hint("merge"), "id", "left").select("id", "text", F.coalesce("mark", F.lit(False)).alias("mark"))
    if not few:
        marked = saved(marked, "marked-texts")
    n = F.regexp_count("text", F.lit(_EVENTS))
    counted = marked.select("mark", n.alias("n")).where("n > 0")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    own = F.when(F.col("mark"), F.col("n") + 1)
    totals = tuple(counted.agg(total(F.col("n") + 1), F.count(F.lit(1)), total(own), F.count(own)).first())
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-totals[0] // _PART))
    schema = _row_type(field_type(docs, id_col))
    asked = marked.mapInArrow(_ask(parts), schema)
    answered = asked.repartitionById(parts, F.col("to")).mapInArrow(_answer, schema)
    met = answered.repartitionById(parts, F.col("to")).sortWithinPartitions("batch", "part")
    kinds = [(id_col, field_type(docs, id_col)), ("n_tokens", T.LongType()), *((c, T.DoubleType()) for c in ("loss_target", "loss_background", "score"))]
    return met.mapInArrow(_finish(totals, prior, [n for n, _ in kinds]), T.StructType([T.StructField(n, t) for n, t in kinds]))
