"""All queries of the library and their SQL, by key."""

from __future__ import annotations

from . import q_history, q_pixels, q_raster, q_relational, q_sources  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
