"""All checked queries."""

from __future__ import annotations

from armwave.plans import (  # noqa: F401  (imports register the queries)
    assoc_queries,
    column_queries,
    describe_queries,
    join_queries,
    model_queries,
    source_queries,
    text_queries,
    vector_queries,
    wave_queries,
)
from armwave.plans.registry import QUERIES

__all__ = ["QUERIES"]
