"""Line dedup: lines whose normalised form stands in many documents are dropped everywhere.

The key of a line is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars``
code points that occur in at least ``min_docs`` documents lose all their lines; other lines stay, joined by ``\\n``.

How: every document gives the distinct 128-bit hashes (XXH3) of its lines; hashes are counted with map-side
combining, so a line of a third of all documents reaches the reducer as one row a task. Frequent hashes are joined back
to the documents' hashes (adaptive execution broadcasts them only when small, and splits a hot key otherwise), then
gathered per document - never more than the document's own lines - and each text is cut line by line in place.

Defined results: null or empty text is one empty line; every row is a document of its own, so repeated rows count
each; rows with the same or a null id share the list of hashes to drop, which changes nothing because a frequent key
is frequent for all; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, field_type, replaced, saved, texts

_ID, _DROP = "__gl_id", "__gl_drop"


def line_keys(data: bytes, min_chars: int) -> list[bytes | None]:
    """A 16-byte hash for each line, None where its key is too short."""
    digest = xxhash.xxh3_128_digest
    out: list[bytes | None] = []
    for line in data.split(b"\n"):
        key = line.strip().lower()  # bytes: ASCII only, as the key wants
        out.append(digest(key) if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars) else None)
    return out


def _document_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    schema = T.StructType([T.StructField(_ID, field_type(docs, id_col)), T.StructField("h", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        take: list[int] = []
        hashes: list[bytes] = []
        for i, t in enumerate(texts(batch.column(1))):
            own = set(line_keys(t or b"", min_chars))
            own.discard(None)
            hashes += own
            take += [i] * len(own)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(hashes, pa.binary())], names=schema.names)

    return arrow_map(docs.select(id_col, text_col), work, schema, text_col)


def with_frequent(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``__gl_drop``: the hashes of its lines that are frequent (null: none)."""
    hashes = saved(_document_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    # written, so that both sides of the join are plain exchanges and adaptive execution can split a hot line
    frequent = saved(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h"), "frequent-lines")
    drops = hashes.join(frequent, "h", "left_semi").groupBy(_ID).agg(F.collect_set("h").alias(_DROP))
    return docs.join(drops, docs[id_col].eqNullSafe(drops[_ID]), "left").drop(_ID)


def _cut(data: bytes, drop: list[bytes] | None, min_chars: int) -> tuple[int, int, bytes]:
    lines = data.split(b"\n")
    if not drop:
        return len(lines), 0, data
    gone = set(drop)
    keep = [line for line, key in zip(lines, line_keys(data, min_chars), strict=True) if key not in gone]
    return len(lines), len(lines) - len(keep), b"\n".join(keep)


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents, with all their columns, without their frequent lines."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = texts(batch.column(text_col))
        new = [t if not d else _cut(t or b"", d, min_chars)[2] for t, d in zip(old, batch.column(_DROP).to_pylist(), strict=True)]
        text = pa.array(new, pa.binary()).cast(batch.column(text_col).type)
        batch = replaced(batch, text_col, text)
        if length_col in batch.schema.names:
            batch = replaced(batch, length_col, pc.utf8_length(text).cast(batch.schema.field(length_col).type))
        return batch.drop_columns([_DROP])

    return arrow_map(with_frequent(docs, min_docs, min_chars, id_col, text_col), work, docs.schema, text_col)


def digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_lines before, n_dropped and the SHA-256 of what stays."""
    schema = T.StructType([T.StructField(id_col, field_type(docs, id_col)), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_cut(t or b"", d, min_chars) for t, d in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())], names=schema.names
        )

    found = with_frequent(docs.select(id_col, text_col), min_docs, min_chars, id_col, text_col)
    return arrow_map(found.select(id_col, text_col, _DROP), work, schema, text_col)
