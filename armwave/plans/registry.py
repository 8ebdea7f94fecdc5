"""Registry of checked queries: a Spark query, the operators it covers, and its SQL twin if there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from armwave.functions.numbers import CUT


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query. ``covers`` lists inventory ids, separated by blanks."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return add


def sfix(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.numbers.fixed``."""
    return f"floor(({expr}) * 1e{digits} + {CUT}) / 1e{digits}"
