"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a public model file: the normaliser (dummy prefix, space to U+2581), the pieces and the
byte fallback. Composed with an input it is a lattice: its states are (position, last piece), its arcs read one piece or
one character that no piece holds (which writes its UTF-8 bytes' pieces). Weights are in the tropical semiring. A
merge-based (BPE) model has no additive piece weights that give its segmentation, so an arc weighs 0 where its piece may
follow the last one and infinity where merging would not have left the two side by side; the text's segmentation is the
one whose neighbours are all compatible, hence the only path of finite weight, and it is the shortest path. It is looked
for depth first, the longest piece first, and a state that leads nowhere is entered once. Summing the scores in the file
instead would be the unigram rule and gives other ids than the library; tests hold the ids against it.

No piece holds U+2581 behind another character and none holds a line feed, so (checked when compiled) segmentation never
crosses these, inputs are cut there, and each worker keeps the paths of chunks that it has seen, a bounded number.

Defined results: null and empty texts have no ids and decode to an empty text; U+2581 in a text comes back as a space, as
in the library; repeated rows are encoded one by one; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, field_type, texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
_REMEMBERED = 1 << 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, or bytes of fixed and length-delimited fields."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[i]
            n |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return n, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind == 5:
            value, i = data[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    merges: bool = False
    byte_fallback: bool = False
    dummy_prefix: bool = True


def read_model(data: bytes) -> Model:
    model, strip = Model(), True
    for number, value in _fields(data):
        if number == 1:
            piece = {k: v for k, v in _fields(value)}
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.merges, model.byte_fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2):
                raise ValueError("the normaliser holds a character map; only the identity is supported")
            model.dummy_prefix, strip = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if not model.merges or not model.byte_fallback or strip:
        raise ValueError("only merge-based models with byte fallback that keep white space are supported")
    return model


#: The only arc where no piece begins: one character, written as bytes.
_ALONE = ((-1, 1),)


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        usable = {p: (i, s) for i, (p, s, kind) in enumerate(model.pieces) if kind == NORMAL}
        if any(kind in (USER, UNUSED) for _, _, kind in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.score = {p: s for p, (_, s) in usable.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in usable) or any("\n" in p and len(p) > 1 for p in usable):
            raise ValueError("pieces cross the places where inputs are cut")
        self.longest = max(map(len, usable))
        self.merges: dict[int, tuple] = {}
        # the pieces' trie: what follows by character, at "" the arcs of all pieces up to here, (piece, characters), longest first
        self.root: dict = {}
        for p, (i, _) in sorted(usable.items(), key=lambda x: len(x[0])):
            parts, merges = self._merged(p)
            if len(parts) == 1:  # a piece that merging can't build is never part of a path
                self.merges[i] = merges
                self._grow(p, i)
        self.root[""] = _ALONE
        self.follows = _Follows(self)
        self.paths = _Paths(self)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        self.labels = [struct.pack("<i", i) for i in range(len(model.pieces))]
        self.written = [b"" if kind in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in model.pieces]

    def _merged(self, text: str) -> tuple[list[str], tuple]:
        """What merging the best-scored neighbours, leftmost first, leaves of a short text; and for each merge, one after
        the other, its score, the first and the last part before it (minus infinity and what is left at the end)."""
        parts, merges = list(text), []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            merges += (-math.inf if best is None else best, parts[0], parts[-1])
            if best is None:
                return parts, tuple(merges)
            parts[at : at + 2] = [sys.intern(parts[at] + parts[at + 1])]

    def _grow(self, piece: str, i: int) -> None:
        """Pieces come by length, so that a node has its arcs before longer pieces pass it."""
        node, arcs = self.root, _ALONE
        for c in piece:
            node = node.setdefault(c, {})
            arcs = node.setdefault("", arcs)
        node[""] = ((i, len(piece)), *(arcs if len(piece) > 1 else ()))

    def may_follow(self, last: int, piece: int) -> bool:
        """Whether merging leaves two pieces side by side: the merges of both take turns, the best score and then the
        leftmost first, and none of the parts that meet between them is better."""
        left, right = self.merges[last], self.merges[piece]
        i = j = 0
        while True:
            s, t = left[i], right[j]
            across = self.score.get(left[i + 2] + right[j + 1])
            if across is not None and s < across >= t:
                return False
            if s == t == -math.inf:
                return True
            if s >= t:
                i += 3
            else:
                j += 3

    def path(self, chunk: str) -> bytes:
        """The output labels of the shortest path through the lattice of a chunk, as little-endian 32-bit integers."""
        n, root, longest, follows, labels = len(chunk), self.root, self.longest, self.follows, self.labels
        if len(follows) > _REMEMBERED:
            follows.clear()
        at, last, arcs = 0, -1, None
        way: list[tuple] = []  # the states passed, (position, last piece or -1), with the arcs that were not tried
        out: list[bytes] = []
        closed: set[tuple[int, int]] = set()  # states from which no finite path leads to the end
        while at < n:
            if arcs is None:
                node = root
                for c in chunk[at : at + longest]:
                    below = node.get(c)
                    if below is None:
                        break
                    node = below
                arcs = iter(node[""])
            for piece, size in arcs:
                if (last < 0 or piece < 0 or follows[last << 32 | piece]) and not (closed and (at + size, piece) in closed):
                    way.append((at, last, arcs))
                    out.append(labels[piece] if piece >= 0 else b"".join(labels[self.bytes[b]] for b in chunk[at].encode()))
                    at, last, arcs = at + size, piece, None
                    break
            else:
                if not way:
                    raise AssertionError(f"no finite path for {chunk!r}")
                closed.add((at, last))
                at, last, arcs = way.pop()
                out.pop()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.model.dummy_prefix:
            text = " " + text
        if len(self.paths) > _REMEMBERED:
            self.paths.clear()
        return b"".join(map(self.paths.__getitem__, self.cut(text.replace(" ", SPACE))))

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.written.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


class _Paths(dict):
    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, chunk: str) -> bytes:
        path = self[chunk] = self.transducer.path(chunk)
        return path


class _Follows(dict):
    """By the numbers of two pieces, the first one shifted by 32 bits."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, key: int) -> bool:
        may = self[key] = self.transducer.may_follow(key >> 32, key & 0xFFFFFFFF)
        return may


@functools.cache
def load(path: str) -> Transducer:
    """Compiled once in each worker."""
    with open(path, "rb") as f:
        return Transducer(read_model(f.read()))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_ids, decoded_sha256): the ids of each text and the SHA-256 of what they decode to.

    model: a public SentencePiece model file that is installed on every executor.
    """
    schema = T.StructType([T.StructField(id_col, field_type(docs, id_col)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("decoded_sha256", T.StringType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = load(model)
        coded = [fst.encode((t or b"").decode("utf-8", "replace")) for t in texts(batch.column(1))]
        flat = np.frombuffer(b"".join(coded), "<i4")
        ends = np.cumsum([0] + [len(c) // 4 for c in coded])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        digest = [hashlib.sha256(fst.decode(flat[a:b]).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(ends), pa.int64()), pa.array(digest, pa.string())], names=schema.names)

    return arrow_map(docs.select(id_col, text_col), work, schema, text_col)


def decode(coded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with ``text_col``: what its ids decode to (null: an empty text)."""
    decoded = F.pandas_udf(lambda ids: ids.map(lambda x: load(model).decode(np.asarray(x if x is not None else [], np.int32))), "string")
    return coded.withColumn(text_col, decoded(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
