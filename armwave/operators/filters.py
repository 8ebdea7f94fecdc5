"""Row filters and row flags. All are stateless, so they also accept a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask(df: DataFrame, col: str, op: str, value, delta=None) -> DataFrame:
    """Comparison filter. ``op``: eq, gt, get, lt, let, range (closed) or open (open interval).

    ``range`` takes a value with ``delta`` or a (low, high) pair.
    """
    c = F.col(col)
    if op == "eq":
        return df.where(c == F.lit(value))
    if op == "gt":
        return df.where(c > F.lit(value))
    if op == "get":
        return df.where(c >= F.lit(value))
    if op == "lt":
        return df.where(c < F.lit(value))
    if op == "let":
        return df.where(c <= F.lit(value))
    if op in ("range", "open"):
        if isinstance(value, (tuple, list)):
            low, high = value
        elif delta is not None:
            low, high = value - delta, value + delta
        else:
            raise ValueError("range needs a delta or a (low, high) pair")
        return df.where(c.between(low, high) if op == "range" else (c > low) & (c < high))
    raise ValueError(f"unknown comparison {op!r}")


def exclude(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop the listed values and keep rows where the column is null."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(values)))


def in_codes(col: str, codes: Sequence) -> Column:
    return F.col(col).isin(list(codes))


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed column is present; absent column names are ignored."""
    return df.dropna(how="any", subset=[c for c in cols if c in df.columns])


def cohort_subset(df: DataFrame, event_col: str, event, status_col: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of one event with a completed task, for the listed ids."""
    kept = df.where((F.col(event_col) == F.lit(event)) & (F.col(status_col) == F.lit(1)))
    return kept.join(ids.select(key), key, "left_semi")


def collapse_rater(df: DataFrame, col: str = "rater", labels: Sequence[str] = ("Teacher", "Parent")) -> DataFrame:
    """Reduce long rater labels to the label they start with."""
    out = F.col(col)
    for label in labels:
        out = F.when(F.col(col).startswith(label), F.lit(label)).otherwise(out)
    return df.withColumn(col, out)


def code_group(col: str, parents: Sequence, teachers: Sequence) -> Column:
    """1 for parent codes, 2 for teacher codes, 0 otherwise."""
    return F.when(F.col(col).isin(list(parents)), 1).when(F.col(col).isin(list(teachers)), 2).otherwise(0)


def decode(col: str, mapping: Mapping) -> Column:
    """Code to label through a literal map; unknown codes give null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(col))


def any_flag(items: Sequence[str], on=1, off=0) -> Column:
    """1 if any item equals ``on``, 0 if all items equal ``off``, otherwise null."""
    hit = F.lit(False)
    clear = F.lit(True)
    for item in items:
        hit = hit | F.coalesce(F.col(item) == on, F.lit(False))
        clear = clear & F.coalesce(F.col(item) == off, F.lit(False))
    return F.when(hit, 1).when(clear, 0)


def split_moderator(
    df: DataFrame, moderator: str, no_values: Sequence, yes_values: Sequence, day: str = "day", low=None, high=None
) -> DataFrame:
    """Add ``mod_group`` (no / yes) and keep rows of either group inside the closed day range."""
    group = F.when(F.col(moderator).isin(list(no_values)), "no").when(F.col(moderator).isin(list(yes_values)), "yes")
    out = df.withColumn("mod_group", group).where(F.col("mod_group").isNotNull())
    if low is not None:
        out = out.where(F.col(day) >= low)
    if high is not None:
        out = out.where(F.col(day) <= high)
    return out


def label_by_contains(text: str, mapping: Sequence[tuple[str, str]], current: str) -> Column:
    """Label of the first mapping key that the text contains, else the current label."""
    hits = [F.when(F.col(text).contains(key), F.lit(label)) for key, label in mapping]
    return F.coalesce(*hits, F.col(current))


def equal_flag(a: str, b: str) -> Column:
    """Null-safe equality of two columns."""
    return F.col(a).eqNullSafe(F.col(b))
