"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader updates.

A word (anything between ASCII white space) gives its runs of word characters and of other characters as tokens; single
tokens and neighbouring pairs are hashed to ``2**bits`` features, where a pair of equal tokens is one feature of its own.
A document's features have their counts over the root of their total as values, so a score is a sparse dot product with
the weights and a sigmoid.

Training reads labelled rows in the order of a hash of their ids, ``max_train`` of them at most (a documented bound on
the labelled sample; all documents are scored), one update each, in a single task that streams them: FTRL-proximal with
the per-coordinate step alpha / (beta + sqrt(sum of squared gradients)), l1 and l2. The weights, 2**bits floats, are sent
to every worker. The intercept is a feature of every document, so empty texts get the prior's score.

Defined results: a null text counts as empty; repeated rows are scored (and, where labelled, learnt) one by one; labels
that are null take no part, and of several labels of an id the largest counts; a null id is never learnt from; without
labelled rows every score is 0.5; only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, field_type, pieces, texts

_TOKENS = re.compile(r"\w+|[^\w\s]+|\s+").findall
_REMEMBERED = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Tokens(dict):
    """word -> its tokens' 64-bit hashes, remembered for words seen before."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = b"".join([xxhash.xxh64_digest(t.encode()) for t in _TOKENS(word.decode("utf-8", "replace"))])
        return found


class Features:
    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.tokens = _Tokens()
        self.bias = (1 << bits) - 1

    def of(self, data: bytes) -> np.ndarray:
        """Feature numbers, repeats included; the intercept isn't among them."""
        if len(self.tokens) > _REMEMBERED:
            self.tokens.clear()
        h = np.frombuffer(b"".join(map(self.tokens.__getitem__, data.split())), ">u8").astype(np.uint64)
        if not len(h):
            return np.zeros(0, np.int64)
        pair = (h[:-1] * _MIX) ^ (h[1:] + _MIX)
        pair[h[:-1] == h[1:]] = np.uint64(1)
        return ((np.concatenate([h, pair]) * _MIX) >> self.shift).astype(np.int64)


def train(rows: Iterator[tuple[bytes, int]], bits: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after one FTRL-proximal update for each (text, label)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    features = Features(bits)
    for text, label in rows:
        f = features.of(text)
        u, c = np.unique(f, return_counts=True)
        u, x = np.append(u, features.bias), np.append(c / np.sqrt(max(1, len(f))), 1.0)
        zu, nu = z[u], n[u]
        w = np.where(np.abs(zu) > l1, (np.sign(zu) * l1 - zu) / ((beta + np.sqrt(nu)) / alpha + l2), 0.0)
        g = (_sigmoid(float(w @ x)) - label) * x
        z[u] = zu + g - (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha * w
        n[u] = nu + g * g
    return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, known: DataFrame, bits: int = 20, max_train: int = 20_000, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0) -> np.ndarray:
    """Weights from docs (id, text) and known (id, label 0 or 1), trained in one task over at most max_train labels in hash order."""
    taken = known.select("id", F.col("label").cast("int").alias("label"), F.md5(F.col("id").cast("string")).alias("h")).orderBy("h", "id").limit(max_train)
    # max_train ids at most are sent to the scan, so only the sample's texts are shuffled, into one task
    rows = docs.join(F.broadcast(taken), "id").repartition(1).sortWithinPartitions("h", "id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in pieces(batches, "text"):
                yield from zip((t or b"" for t in texts(b.column("text"))), b.column("label").to_pylist(), strict=True)

        w = train(each(), bits, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "weight"])

    found = rows.select("text", "label").mapInArrow(work, "feature long, weight double").toArrow()
    weights = np.zeros(1 << bits, np.float32)
    weights[found.column("feature").to_numpy()] = found.column("weight").to_numpy()
    return weights


def fold(id_: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.pmod(F.crc32(id_.cast("string")), F.lit(folds))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    schema = T.StructType([T.StructField(id_col, field_type(docs, id_col)), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    bits = len(weights).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, features = sent.value, _features(bits)
        out = []
        for t in texts(batch.column(1)):
            f = features.of(t or b"")
            out.append(w[f].sum(dtype=np.float64) / np.sqrt(max(1, len(f))) + w[features.bias])
        p = _sigmoid(np.array(out))
        held = [i is not None and zlib.crc32(str(i).encode()) % folds == 0 for i in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return arrow_map(docs.select(id_col, text_col), work, schema, text_col)


_kept: dict[int, Features] = {}


def _features(bits: int) -> Features:
    return _kept.setdefault(bits, Features(bits))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3, **how) -> DataFrame:
    """Learns from the labelled documents outside fold 0 and scores all documents."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where(fold(F.col("id"), folds) != 0)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return score(docs, fit(own, known, **how), threshold, folds, id_col, text_col)
