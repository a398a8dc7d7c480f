"""All registered queries of the graph engine and their DuckDB oracles."""

from __future__ import annotations

from .plans import analysis, questions, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (questions, analysis, texts):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
