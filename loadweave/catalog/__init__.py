"""Registered queries: each operator on the given tables, with its SQL counterpart."""

from __future__ import annotations

from loadweave.catalog import (  # noqa: F401
    align_queries,
    column_queries,
    dedup_queries,
    feature_queries,
    live_queries,
    reshape_queries,
    seasonal_queries,
    source_queries,
)
from loadweave.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
