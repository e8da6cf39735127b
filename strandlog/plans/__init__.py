"""Named queries over the test tables, each with the SQL that it is held against."""

from __future__ import annotations

from . import completeness, ingest, listing, projection, state, streams, text
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["completeness", "ingest", "listing", "oracle_sql", "projection", "queries", "state", "streams", "text"]
