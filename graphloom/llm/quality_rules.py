"""Line-first cleaning: rules judge every line, failed lines go, documents that lose too much text are rejected.

Words are maximal runs of anything but ASCII white space. A line fails if any rule says so:

* punctuation: no word of the line ends a sentence (``ENDS``, of many scripts, and ``CLOSINGS`` after them);
* navigation: separators such as ``|`` or ``»`` stand as words of their own, three or more and at least
  ``max_separator_share`` of the words;
* symbols: at least ``max_symbol_share`` of three or more words hold one of ``#*$%&|<>``;
* shouting: of five or more words at least ``max_loud_share`` end in ``!``, or of the letters are capitals;
* monotony: twenty or more words with fewer than ``min_distinct_share`` distinct ones;
* boilerplate: at most ``boilerplate_words`` words that hold one of ``boilerplate`` (lower case).

Lines without a word never fail and never count. A document is kept if its base statistics pass and it loses at
most ``max_lost_share`` of its words.

Defined results: null or empty text has no words and fails the base rule; repeated rows are judged one by one; other
columns are not read; an empty table gives an empty result. Each row is judged alone, so there is no shuffle and a
task holds one batch of texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, field_type, replaced, texts

#: Marks that end a sentence: Latin, CJK (full and half width), Devanagari, Arabic, Urdu, Ethiopic, Armenian, Khmer, Burmese.
ENDS = ".!?…。！？．｡।॥؟۔።։။"
#: Marks that may close it.
CLOSINGS = "\"')]»’”“」』）】》"
_any = lambda marks: b"(?:" + b"|".join(re.escape(c.encode()) for c in marks) + b")"
_END = re.compile(_any(ENDS) + _any(CLOSINGS) + rb"*(?:[\x20\x09-\x0d]|$)")
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_SEPARATORS = {s.encode() for s in ("|", "||", "»", "«", "›", "‹", "•", "·", ">", "<", ">>", "<<", "/", "→")}
_SYMBOLS = "#*$%&|<>"
_BLANK_BYTES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    max_separator_share: float = 0.15
    max_symbol_share: float = 0.3
    max_loud_share: float = 0.5
    min_distinct_share: float = 0.2
    boilerplate_words: int = 40
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "accept cookies", "cookie policy", "cookie settings", "privacy policy",
        "terms of use", "terms of service", "terms and conditions", "enable javascript", "sign up for our newsletter",
        "subscribe to our newsletter", "click here to", "skip to content", "back to top", "lorem ipsum",
        "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
    )
    max_lost_share: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30


def line_fails(line: bytes, words: list[bytes], rules: LineRules) -> bool:
    n = len(words)
    if not _END.search(line):
        return True
    bars = sum(w in _SEPARATORS for w in words)
    if bars >= 3 and bars >= rules.max_separator_share * n:
        return True
    if n >= 3 and _SYMBOL.search(line) and sum(1 for w in words if _SYMBOL.search(w)) >= rules.max_symbol_share * n:
        return True
    if n >= 5:
        if line.count(b"!") >= rules.max_loud_share * n and sum(w.endswith(b"!") for w in words) >= rules.max_loud_share * n:
            return True
        text = line.decode("utf-8", "replace")
        lower = text.lower()
        changed = sum(map(str.isupper, text)) if lower != text else 0
        if changed > rules.max_loud_share * sum(map(str.isalpha, text)):
            return True
    if n >= 20 and len(set(words)) < rules.min_distinct_share * n:
        return True
    if n <= rules.boilerplate_words:
        low = line.decode("utf-8", "replace").lower()
        return any(p in low for p in rules.boilerplate)
    return False


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` (a power of two) words that occur twice or more, compared exactly.

    Ranks of windows of 1, 2, 4 ... words come from sorting pairs of ranks, so nothing rests on a hash.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    span = 1
    while span < width:
        pair = rank[:-span] * (len(words) + 1) + rank[span:]
        found, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(found) == len(pair):
            return 0
        span *= 2
    starts = np.flatnonzero(count[rank] > 1)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(mark)))


def judge(data: bytes, rules: LineRules) -> tuple[int, int, int, int, int, bool, bool, int, int, bytes | None]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed lines, lost words, cleaned text or None if unchanged."""
    words = data.split()
    n = len(words)
    n_chars = len(data.decode("utf-8", "replace")) - sum(map(data.count, _BLANK_BYTES))
    n_symbols = sum(data.count(c.encode()) for c in _SYMBOLS)
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup, lost, keep = 0, 0, []
    for line in lines:
        own = line.split()
        if not own:
            keep.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, own, rules):
            lost += len(own)
        else:
            keep.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    kept = not failed and lost <= rules.max_lost_share * n
    return n, n_chars, n_symbols, dup, repeat, failed, kept, len(lines) - len(keep), lost, b"\n".join(keep) if len(keep) < len(lines) else None


def score(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, base statistics, the verdict and what the line rules removed."""
    schema = T.StructType(
        [T.StructField(id_col, field_type(docs, id_col))]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
        + [T.StructField(c, T.LongType()) for c in ("n_failed_lines", "n_lost_words")]
    )
    names = schema.names[1:]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t or b"", rules)[:9] for t in texts(batch.column(1))]
        out = [batch.column(0), *(pa.array([r[k] for r in rows], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for k, n in enumerate(names))]
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    return arrow_map(docs.select(id_col, text_col), work, schema, text_col)


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, with all their columns, without their failed lines; ``length_col`` follows the text if present."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = texts(batch.column(text_col))
        found = [judge(t or b"", rules) for t in old]
        kept = pa.array([f[6] for f in found], pa.bool_())
        new = pa.array([t if f[9] is None else f[9] for t, f in zip(old, found, strict=True)], pa.binary()).cast(batch.column(text_col).type)
        batch = replaced(batch, text_col, new)
        if length_col in batch.schema.names:
            i = batch.schema.get_field_index(length_col)
            import pyarrow.compute as pc

            batch = replaced(batch, length_col, pc.utf8_length(new).cast(batch.schema.field(i).type))
        return batch.filter(kept)

    return arrow_map(docs, work, docs.schema, text_col)
