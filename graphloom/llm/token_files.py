"""Token-id files: texts are encoded, written as binary files by an adaptive context-mixing range coder, and read back.

The coder mixes the predictions of three orders into one distribution. The two ids before an id name a candidate (order
2: what followed them last), the one before it another (order 1), and order 0 has the frequencies of all ids so far,
each id counted once at least:

    P(x) = w2 [x = candidate 2] + w1 [x = candidate 1] + w0 f0(x)

The weights are adaptive: for each pair of confidences (how often in a row the candidates were right) they follow how
often candidate 2, candidate 1 or neither was right. A range coder with a 64-bit window codes each id in one step.

Blocks of up to ``BLOCK`` ids are coded independently: every model starts anew and each block has a CRC-32, so any block
can be read alone and damage is found. Within a block runs of ``STEPS`` ids are lanes with a coder each; all lanes take
a step together, predicted by the block's models, which then learn from that step (order 0 every few steps). So a step
is a handful of numpy operations over up to 4096 ids.

A file is a sequence of segments (little-endian; a line feed follows each):
    magic b"GLT2", u32 bytes of the rest, u32 documents, u32 blocks, u32 ids a block, u64 ids in all,
    i64 document ids (the smallest for null) and u32 numbers of ids, u32 bytes and u32 CRC-32 (of the ids) of each block,
    u32 CRC-32 of all before, then the blocks. A block is u32 ids it tells apart, then for each lane u16 coded words,
    then the words of all lanes.
Segments end at document boundaries and hold about ``SEGMENT`` ids, a file holds at most ``SEGMENTS`` of them; files
ascend by document id. They are written by Spark's own committer (a task that fails or runs twice leaves nothing behind)
to any file system it knows and read by its binaryFile source. Ids may be as large as 2**20 - 1.

Defined results: null and empty texts have the end id only; repeated rows are written one by one, in any order among
equals; null ids come first; only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, saved, scratch

MAGIC, BLOCK, STEPS, SEGMENT, SEGMENTS = b"GLT2", 1 << 20, 256, 1 << 20, 48
_PART_BYTES = 64 << 20
_NULL = -(1 << 63)
_HEAD = struct.Struct("<IIIIQ")
_PLACES = (1 << 17) - 1  # order 2's table
_WEIGHT = 11  # bits of the weights' total; with up to 20 bits of order 0 an end of a share fits 32 bits
_WEIGH = 8  # steps between two settings of the weights
_LEARN = 64  # steps between two counts of order 0, which also follow the steps 1, 2, 4 ...
_FLOOR, _16, _48 = np.uint64(1 << 48), np.uint64(16), np.uint64(48)
_LEVEL = np.arange(32) & 15
_HAS2, _HAS1 = (_LEVEL >> 2) > 0, ((_LEVEL & 3) > 0) & (np.arange(32) < 16)  # states in which a candidate has weight


class _Mixture:
    """The models of one block; encoder and decoder make the same calls."""

    def __init__(self, kinds: int, lanes: int):
        self.kinds = kinds
        self.bits = max(20, (kinds - 1).bit_length() + 4)  # of order 0's total
        self.total = _WEIGHT + self.bits
        self.number = np.uint32 if self.total <= 31 else np.uint64  # of positions in the total
        self.after1 = np.full(kinds + 1, -4, np.int32)  # candidate * 4 + confidence
        self.after2 = np.full(_PLACES + 1, -4, np.int32)
        self.counts = np.zeros(kinds, np.int64)
        self.right = np.ones((32, 4), np.int64)  # neither, candidate 1, candidate 2; the last column is not used
        self.right[:, 3] = 0
        self.p1, self.p2 = np.full(lanes, kinds, np.int64), np.full(lanes, kinds, np.int64)
        self.step, self.held, self.outcomes = 0, [], []
        self._frequencies()
        self._weights()

    def _frequencies(self) -> None:
        whole = 1 << self.bits
        f = self.counts * (whole - self.kinds) // max(1, int(self.counts.sum())) + 1
        f[np.argmax(self.counts)] += whole - int(f.sum())
        self.f = f.astype(self.number)
        self.below = (np.cumsum(f) - f).astype(self.number)
        self.slots = None

    def _weights(self) -> None:
        every = self.right.sum(axis=1)
        share = ((1 << _WEIGHT) - 48) * self.right // every[:, None] + 16
        w2, w1 = np.where(_HAS2, share[:, 2], 0), np.where(_HAS1, share[:, 1], 0)
        self.w0 = ((1 << _WEIGHT) - w2 - w1).astype(self.number)
        self.w2, self.w1 = ((w << self.bits).astype(self.number) for w in (w2, w1))

    def predict(self, k: int) -> None:
        """For the next ids of the first k lanes."""
        p1, p2 = self.p1[:k], self.p2[:k]
        self.i1, self.i2 = p1, (p1 * 0x9E3779B1 + p2 * 0x85EBCA6B) >> 14 & _PLACES
        self.t1, self.t2 = self.after1.take(self.i1), self.after2.take(self.i2)
        self.a1, self.a2 = self.t1 >> 2, self.t2 >> 2
        k1 = self.t1 & 3
        self.state = ((self.t2 & 3) << 2) + k1 + (((self.a1 == self.a2) & (k1 > 0)).view(np.int8) << 4)
        self.m2, self.m1, self.m0 = self.w2.take(self.state), self.w1.take(self.state), self.w0.take(self.state)

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the ids' shares of 2**total."""
        small, n = x.astype(np.int32), self.number
        start = self.m0 * self.below.take(x) + self.m2 * (self.a2 < small).view(np.int8).astype(n) + self.m1 * (self.a1 < small).view(np.int8).astype(n)
        length = self.m0 * self.f.take(x) + self.m2 * (self.a2 == small).view(np.int8).astype(n) + self.m1 * (self.a1 == small).view(np.int8).astype(n)
        return start, length

    def at(self, v: np.ndarray) -> np.ndarray:
        """The ids whose shares hold v."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.kinds, dtype=np.uint16 if self.kinds <= 1 << 16 else np.int32), self.f.astype(np.int64))
        n = self.number
        c2, c1 = np.maximum(self.a2, 0).astype(np.int64), np.maximum(self.a1, 0).astype(np.int64)
        v2 = v - (self.m0 * self.below.take(c2) + self.m1 * (self.a1 < self.a2).view(np.int8).astype(n))  # wraps below the share
        v1 = v - (self.m0 * self.below.take(c1) + self.m2 * (self.a2 < self.a1).view(np.int8).astype(n))
        n2, n1 = self.m2 + self.m0 * self.f.take(c2), self.m1 + self.m0 * self.f.take(c1)
        over2, over1 = (v >= (v - v2) + n2).view(np.int8).astype(n), (v >= (v - v1) + n1).view(np.int8).astype(n)
        slot = ((v - self.m2 * over2 - self.m1 * over1) // self.m0).astype(np.int64)
        x = self.slots.take(slot, mode="clip").astype(np.int64)
        x = np.where((v1 < n1) & (self.m1 > 0), c1, x)
        return np.where((v2 < n2) & (self.m2 > 0), c2, x)

    def learn(self, x: np.ndarray) -> None:
        small = x.astype(np.int32)
        hit1, hit2 = self.a1 == small, self.a2 == small
        fresh = (small << 2) + 1
        self.after1[self.i1] = np.where(hit1, np.minimum(self.t1 + 1, fresh + 2), fresh)
        self.after2[self.i2] = np.where(hit2, np.minimum(self.t2 + 1, fresh + 2), fresh)
        self.outcomes.append((self.state << 2) + np.maximum(hit2.view(np.int8) << 1, hit1.view(np.int8)))
        k = len(x)
        self.p2[:k] = self.p1[:k]
        self.p1[:k] = x
        self.step += 1
        self.held.append(x)
        if self.step % _WEIGH == 0 or self.step < _WEIGH:
            self.right += np.bincount(np.concatenate(self.outcomes), minlength=128).reshape(32, 4)
            self.outcomes = []
            self._weights()
        if self.step % _LEARN == 0 or self.step & (self.step - 1) == 0:
            self.counts += np.bincount(np.concatenate(self.held), minlength=self.kinds)
            self.held = []
            self._frequencies()


def code_block(ids: np.ndarray) -> bytes:
    """One coded block of 1 to BLOCK ids."""
    count, kinds = len(ids), int(ids.max()) + 1
    lanes, steps = -(-count // STEPS), min(STEPS, count)
    last = count - (lanes - 1) * STEPS
    columns = np.zeros(lanes * STEPS, np.int64)
    columns[:count] = ids
    columns = np.ascontiguousarray(columns.reshape(lanes, STEPS).T)
    model = _Mixture(kinds, lanes)
    total = np.uint64(model.total)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, steps * 3 + 8), np.uint16)  # 36 bits an id at most
    flat, row = words.reshape(-1), np.arange(lanes) * words.shape[1]
    size = row.copy()

    def add(at: np.ndarray | slice, more: np.ndarray) -> None:
        low[at] += more
        over = np.flatnonzero(low[at] < more)
        back = size[at][over] - 1
        while len(back):  # carry into the words before
            flat[back] += np.uint16(1)
            back = back[flat[back] == 0] - 1

    def emit(at: np.ndarray) -> None:
        top = low[at]
        flat[size[at]] = top >> _48
        size[at] += 1
        low[at] = top << _16

    for s in range(steps):
        k = lanes if s < last else lanes - 1
        x = columns[s, :k]
        model.predict(k)
        start, length = model.interval(x)
        r = span[:k] >> total
        add(slice(0, k), r * start)
        span[:k] = r * length
        short = np.flatnonzero(span[:k] < _FLOOR)
        while len(short):
            emit(short)
            span[short] <<= _16
            short = short[span[short] < _FLOOR]
        model.learn(x)
    every = np.arange(lanes)
    add(every, (np.uint64(0) - low) & np.uint64((1 << 32) - 1))  # two words settle the rest, whatever follows them
    emit(every)
    emit(every)
    used = (size - row).astype("<u2")
    body = [words[i, :n].astype("<u2").tobytes() for i, n in enumerate(used.tolist())]
    return struct.pack("<I", kinds) + used.tobytes() + b"".join(body)


def decode_block(data: bytes, count: int) -> np.ndarray:
    """The count ids that code_block got."""
    lanes, steps = -(-count // STEPS), min(STEPS, count)
    last = count - (lanes - 1) * STEPS
    kinds = struct.unpack_from("<I", data)[0]
    used = np.frombuffer(data, "<u2", lanes, 4).astype(np.int64)
    body = np.frombuffer(data, "<u2", offset=4 + 2 * lanes)
    if not 0 < kinds <= 1 << 20 or used.sum() != len(body):
        raise ValueError("a block is damaged")
    body = np.concatenate([body, np.zeros(8, np.uint16)]).astype(np.uint64)
    end = len(body) - 1
    at = np.cumsum(used) - used
    model = _Mixture(kinds, lanes)
    total, most = np.uint64(model.total), np.uint64((1 << model.total) - 1)
    span, code = np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _16 | body[np.minimum(at, end)]
        at += 1
    columns = np.zeros((STEPS, lanes), np.int64)
    for s in range(steps):
        k = lanes if s < last else lanes - 1
        model.predict(k)
        r = span[:k] >> total
        x = model.at(np.minimum(code[:k] // r, most).astype(model.number))
        start, length = model.interval(x)
        code[:k] -= r * start
        span[:k] = r * length
        short = np.flatnonzero(span[:k] < _FLOOR)
        while len(short):
            code[short] = code[short] << _16 | body[np.minimum(at[short], end)]
            at[short] += 1
            span[short] <<= _16
            short = short[span[short] < _FLOOR]
        model.learn(x)
        columns[s, :k] = x
    return np.ascontiguousarray(columns.T).reshape(-1)[:count]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One segment."""
    if len(ids) and int(ids.max()) >= 1 << 20:
        raise ValueError("ids must be below 2**20")
    blocks = [code_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    sums = [zlib.crc32(ids[a : a + BLOCK].astype("<u4")) for a in range(0, len(ids), BLOCK)]
    index = b"".join([
        np.array([_NULL if i is None else i for i in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(),
        np.array([len(b) for b in blocks], "<u4").tobytes(), np.array(sums, "<u4").tobytes(),
    ])
    body = b"".join(blocks)
    head = MAGIC + _HEAD.pack(_HEAD.size - 4 + len(index) + 4 + len(body), len(doc_ids), len(blocks), BLOCK, len(ids)) + index
    return head + struct.pack("<I", zlib.crc32(head)) + body


def unpack(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, numbers of ids, ids) of each segment of a file; raises ValueError where a checksum fails."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError("not a token file")
        rest, docs, blocks, block, total = _HEAD.unpack_from(data, at + 4)
        i = at + 4 + _HEAD.size
        if i + 12 * docs + 8 * blocks + 4 > len(data):
            raise ValueError("a segment's index is damaged")
        doc_ids = np.frombuffer(data, "<i8", docs, i)
        lengths = np.frombuffer(data, "<u4", docs, i + 8 * docs).astype(np.int64)
        sizes = np.frombuffer(data, "<u4", blocks, i + 12 * docs).astype(np.int64)
        sums = np.frombuffer(data, "<u4", blocks, i + 12 * docs + 4 * blocks)
        i += 12 * docs + 8 * blocks
        if zlib.crc32(data[at:i]) != struct.unpack_from("<I", data, i)[0]:
            raise ValueError("a segment's index is damaged")
        parts, begin = [np.zeros(0, np.int64)], i + 4
        for b in range(blocks):
            parts.append(decode_block(data[begin : begin + int(sizes[b])], min(total - b * block, block)))
            if zlib.crc32(parts[-1].astype("<u4")) != sums[b]:
                raise ValueError(f"block {b} is damaged")
            begin += int(sizes[b])
        yield doc_ids, lengths, np.concatenate(parts)
        at += 8 + rest + 1


class _Worker:
    """A tokenizer and what a Python worker remembers of it: the ids of words and of unusual chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        # lower-case Latin words go straight to the library's model, if the steps before it leave such words as they are
        some = [p.removesuffix("</w>") for p in vocabulary if _LATIN(p.removesuffix("</w>"))]
        some = some[:: max(1, len(some) // 500)] + ["à", "über", "garçon", "señor", "straße", "œuvre", "łódź"]
        self.model = self.tokenizer.model
        self.direct = self._model_ids(some) == self.ids(some)

    def _model_ids(self, words: list[str]) -> list[bytes]:
        read = [x if x.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, x.encode())) for x in words]
        ids: list[int] = []
        ends = [0]
        for tokens in map(self.model.tokenize, read):
            ids += [t.id for t in tokens]
            ends.append(len(ids) * self.dtype.itemsize)
        return list(map(np.array(ids, self.dtype).tobytes().__getitem__, map(slice, ends, ends[1:])))

    def ids(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(f.ids, self.dtype).tobytes() for f in found]

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of words and of runs of marks."""
        latin = [x for x in words if x[-1:].isalpha()] if self.direct else []
        self.words.update(zip(latin, self._model_ids(latin), strict=True))
        rest = [x for x in words if not x[-1:].isalpha()] if self.direct else words
        for a in range(0, len(rest), 10_000):
            self.words.update(zip(rest[a : a + 10_000], self.ids(rest[a : a + 10_000]), strict=True))

    def unusual(self, new: list[bytes]) -> None:
        """Remembers the ids of chunks that aren't a Latin word and marks behind it.

        The vocabulary's pre-tokenizer drops white space and splits letters, numbers and other characters; it lower-cases
        before. So chunks of ASCII and Latin letters fall into runs of punctuation and of the rest, others stay whole.
        """
        split = {}
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            split[chunk] = [text] if _INTRICATE(text) else _RUNS(text.lower())
        parts = list({p for own in split.values() for p in own})
        found = {p: i for a in range(0, len(parts), 10_000) for p, i in zip(parts[a : a + 10_000], self.ids(parts[a : a + 10_000]), strict=True)}
        for chunk, own in split.items():
            self.chunks[chunk] = b"".join([found[p] for p in own])


_worker = functools.cache(_Worker)

_LATIN = re.compile("[a-z]+").fullmatch
_WORD = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"  # no letter whose lower case is more than one letter
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level models
_BYTE_LETTERS = [chr(b) if b in _SHOWN else chr(256 + b - sum(s < b for s in _SHOWN)) for b in range(256)]
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
# Texts where a boundary of ASCII punctuation could lie inside a pre-token: control characters, apostrophes, anything but
# ASCII and Latin letters, special tokens.
_INTRICATE = re.compile("[\x00-\x08\x0e-\x1f'\x7f-\xbf\xd7\xf7\u0130\u0250-\U0010ffff]|<\\|").search
_RUNS = re.compile(r"[!-/:-@\[-`{-~]+|[^\s!-/:-@\[-`{-~]+").findall
_REMEMBERED = 1 << 20


def _ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first : first + size] of each row, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def encode_column(column: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by the end id; how many each text has).

    A text's ids are those of its chunks, the runs of anything but ASCII white space. Each different chunk is looked at
    once a batch, and the worker remembers the ids of words, so the library sees a word once in a long while.
    """
    w = _worker(path)
    for known in (w.words, w.chunks):
        if len(known) > _REMEMBERED:
            known.clear()
    split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string(), safe=False), ""))
    coded = split.flatten().dictionary_encode()
    kinds = coded.dictionary
    stems = pc.ascii_rtrim(kinds, characters=_MARKS)
    tail = pc.binary_length(kinds).to_numpy() - pc.binary_length(stems).to_numpy()
    usual = pc.match_substring_regex(stems, _WORD).to_numpy(zero_copy_only=False)
    latin = pc.utf8_lower(stems.filter(pa.array(usual))).dictionary_encode()
    marked, rest = np.flatnonzero(usual & (tail > 0)), np.flatnonzero(~usual)
    ends = [c[-n:] for c, n in zip(kinds.take(pa.array(marked)).to_pylist(), tail[marked].tolist(), strict=True)]
    marks = pa.array(ends, pa.string()).dictionary_encode()
    words = latin.dictionary.to_pylist() + marks.dictionary.to_pylist()
    w.learn([x for x in words if x not in w.words])
    others = kinds.take(pa.array(rest)).cast(pa.binary()).to_pylist()
    w.unusual([x for x in others if x not in w.chunks])
    # a pool of ids: words, runs of marks, unusual chunks, nothing; each chunk is two of them
    pool = [*map(w.words.__getitem__, words), *map(w.chunks.__getitem__, others), b""]
    size = np.fromiter(map(len, pool), np.int64, len(pool)) // w.dtype.itemsize
    first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(pool), w.dtype)
    two = np.full((len(kinds), 2), len(pool) - 1)
    two[usual, 0] = latin.indices.to_numpy()
    two[marked, 1] = len(latin.dictionary) + marks.indices.to_numpy()
    two[rest, 0] = len(words) + np.arange(len(rest))
    flat, size = _ragged(flat, first[two].reshape(-1), size[two].reshape(-1)), size[two].sum(axis=1)
    first, which = np.cumsum(size) - size, coded.indices.to_numpy()
    ids = _ragged(flat, first[which], size[which])
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[which])])[offsets]
    return np.insert(ids, bounds[1:], end), np.diff(bounds) + 1


def encode_texts(batch: list[bytes | None], path: str, end: int) -> list[bytes]:
    """Ids of each text and the end id, as little-endian integers of 16 bits (32 for vocabularies over 65536)."""
    ids, lengths = encode_column(pa.array(batch, pa.binary()), path, end)
    stops = np.cumsum(lengths)
    return [ids[a:b].tobytes() for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Token files of all documents under ``path``, in ascending order of their ids.

    Rows are dealt by ranges of (id, hash of the text), so many rows of one id, or without one, fill several parts.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if partitions is None:
        size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _PART_BYTES))
    order = F.col("id").asc_nulls_first(), F.xxhash64("text")
    ordered = own.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        lengths: list[int] = []
        coded: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            segment = pack(names, lengths, np.concatenate(coded).astype(np.int64))
            for held in (names, lengths, coded):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], names=["segment"])

        for batch in pieces(batches, "text", 16 << 20):
            ids, n = encode_column(batch.column("text"), tokenizer, end)
            ends, at = np.cumsum(n), 0
            while at < len(n):  # to the document that fills the segment
                begin = int(ends[at] - n[at])
                to = min(len(n), int(np.searchsorted(ends, begin + SEGMENT - sum(lengths))) + 1)
                names += batch.column("id").slice(at, to - at).to_pylist()
                lengths += n[at:to].tolist()
                coded.append(ids[begin : int(ends[to - 1])])
                at = to
                if sum(lengths) >= SEGMENT:
                    yield out()
        if names:
            yield out()

    made = ordered.mapInArrow(segments, "segment binary").select(F.col("segment").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", SEGMENTS).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, offset, doc_id, n_tokens, ids): every document in the token files under ``path``, ids as little-endian 32-bit integers.

    offset counts the ids before the document in its file, first is the file's first document.
    """
    return _files(spark, path).mapInArrow(functools.partial(_documents, digest=False), "file string, first long, offset long, doc_id long, n_tokens long, ids binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").schema(T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])).option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def _documents(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            name, offset, first = batch.column("path")[r].as_py(), 0, None
            for doc_ids, lengths, ids in unpack(batch.column("content")[r].as_py()):
                ends = np.cumsum(lengths)
                starts = ends - lengths
                first = int(doc_ids[0]) if first is None and len(doc_ids) else first
                wide = ids.astype("<u4")
                if digest:
                    last = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.array([wide[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([first] * n, pa.int64()), pa.array(starts + offset), pa.array(doc_ids.astype(np.int64), mask=doc_ids == _NULL), pa.array(lengths), last],
                    names=["file", "first", "offset", "doc_id", "n_tokens", "ids_crc32" if digest else "ids"],
                )
                offset += int(lengths.sum())


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from token files that are written and read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer, end, id_col, text_col)
    found = saved(_files(spark, path).mapInArrow(functools.partial(_documents, digest=True), "file string, first long, offset long, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    files = found.groupBy("file", "first").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(files, "file").select(F.col("doc_id").alias(id_col), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
