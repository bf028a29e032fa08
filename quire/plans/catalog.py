"""All registered queries of the reading engine and their equivalent DuckDB SQL."""

from __future__ import annotations

from quire.plans import (  # noqa: F401  importing registers their queries
    activity_queries,
    clip_queries,
    document_queries,
    join_queries,
    order_queries,
    page_queries,
    position_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from quire.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
