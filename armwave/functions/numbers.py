"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delay in days of each indifference point.
DELAYS = (0.0, 0.25, 1.0, 7.0, 30.0, 90.0, 365.0, 1780.0)


# Fixed value: where ``fixed`` cuts between two steps. Off the half, so that a mean of short decimals
# never lies on the edge and the order of additions cannot change the result.
CUT = 0.3183098861


def fixed(c: str | Column, digits: int = 6) -> Column:
    """Value on a grid of ``digits`` decimals, by the same arithmetic on every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(10.0**digits) + F.lit(CUT)) / F.lit(10.0**digits)


def truncate(c: str | Column, digits: int) -> Column:
    """Cut toward zero to ``digits`` decimals."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.floor(F.abs(c) * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(c < 0, -cut).otherwise(cut)


def round_to(c: str | Column, digits: int) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def discount_rate(indifference: str | Column, delayed: str | Column, delay: float | Column) -> Column:
    """Hyperbolic rate (a - v) / (v * d); zero values or a zero delay give null."""
    v = F.col(indifference) if isinstance(indifference, str) else indifference
    a = F.col(delayed) if isinstance(delayed, str) else delayed
    return F.try_divide(a - v, v * (F.lit(delay) if not isinstance(delay, Column) else delay))


def discount_grid(df: DataFrame, points: Mapping[float, str], delayed: str) -> DataFrame:
    """One rate column ``disc_rate_k<delay>`` per delay."""
    return df.withColumns({f"disc_rate_k{d:g}": discount_rate(c, delayed, float(d)) for d, c in points.items()})


def direction(coef: str | Column, p: str | Column, alpha: float | Column = 0.05) -> Column:
    """'<' if significant and above zero, '>' if significant and below zero, else '~'."""
    c = F.col(coef) if isinstance(coef, str) else coef
    p = F.col(p) if isinstance(p, str) else p
    sig = p < (F.lit(alpha) if not isinstance(alpha, Column) else alpha)
    return F.when(sig & (c > 0), "<").when(sig & (c < 0), ">").otherwise("~")


def agreement(published: Column, replicated: Column) -> Column:
    """'both', 'one' or 'none' of two significance flags; unknown counts as not significant."""
    a, b = F.coalesce(published, F.lit(False)), F.coalesce(replicated, F.lit(False))
    return F.when(a & b, "both").when(a | b, "one").otherwise("none")
