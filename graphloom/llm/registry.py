"""The corpus operators' queries and oracles, for the driver's entry module."""

from __future__ import annotations

import re

from . import queries as _queries
from . import sql as _sql


def queries() -> dict:
    return {n: f for n, f in vars(_queries).items() if re.match(r"op\d+_", n)}


def oracle_sql() -> dict[str, str]:
    return dict(_sql.ORACLES)
