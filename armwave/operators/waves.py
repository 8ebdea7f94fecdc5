"""Time windows, one row per subject, rolling and point averages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwave.operators.ordering import row_index

# Cumulative window cuts in days, and the cuts of the variant with an exact baseline.
CUTS = {"b": 46, "14": 168, "24": 319, "36": 500}
LONG_CUTS = {"14": 578, "24": 912, "36": 1195}


def split_waves(df: DataFrame, cuts: Mapping[str, int] = CUTS, day: str = "day", baseline: str | None = None,
                out: str = "wave") -> DataFrame:
    """A row joins every window with ``day < cut``; with ``baseline``, that window means day 0.

    The windows of a row are built as a short array and exploded in the same stage: no shuffle.
    """
    tests = [(F.col(day) < cut, name) for name, cut in cuts.items()]
    if baseline is not None:
        tests.insert(0, (F.col(day) == 0, baseline))
    return _explode_tests(df.where(F.col(day).isNotNull()), tests, out)


def _explode_tests(df: DataFrame, tests: Sequence[tuple[Column, str]], out: str) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
    return df.withColumn(out, F.explode(names))


def split_waves_custom(df: DataFrame, timepoints: Sequence[int], how: str = "lt", delta: int | None = None,
                       day: str = "day", out: str = "wave") -> DataFrame:
    """Windows by ``lt``, ``gt`` or ``range`` (closed, +- delta); a first timepoint 0 means day 0."""
    d = F.col(day)
    tests = []
    for i, t in enumerate(timepoints):
        if i == 0 and t == 0:
            test = d == 0
        elif how == "lt":
            test = d < t
        elif how == "gt":
            test = d > t
        elif how == "range":
            test = d.between(t - delta, t + delta)
        else:
            raise ValueError(f"unknown split {how!r}")
        tests.append((test, t))
    return _explode_tests(df.where(d.isNotNull()), tests, out)


def band(df: DataFrame, low: int | None, high: int | None, day: str = "day", open_low: bool = False) -> DataFrame:
    """Rows of the disjoint band [low, high), or (low, high) with ``open_low``."""
    if low is not None:
        df = df.where(F.col(day) > low if open_low else F.col(day) >= low)
    return df.where(F.col(day) < high) if high is not None else df


def log_days(day: str = "day") -> Column:
    """log(day + 1); null days (and days below zero, which have no logarithm) give 0."""
    return F.coalesce(F.log1p(F.when(F.col(day) > -1, F.col(day))), F.lit(0.0))


def month_of(col: str) -> Column:
    return F.to_date(F.date_trunc("month", F.col(col)))


def days_to_months(col: str) -> Column:
    return F.col(col) / F.lit(30)


def one_per_subject(df: DataFrame, key: str | Sequence[str], select: str = "min", day: str = "day",
                    tiebreak: str = "visit_id", lower: int | None = None) -> DataFrame:
    """The row with the smallest or largest day of each key; ties go to the smallest tie-break.

    A struct minimum combines on the map side, so a subject with very many rows is no problem.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if lower is not None:
        df = df.where(F.col(day) > lower)
    first = F.col(day) if select == "min" else -F.col(day)
    rest = [c for c in df.columns if c not in (*keys, tiebreak)]
    best = F.min(F.struct(first.alias("_o"), F.col(tiebreak), *rest)).alias("_best")
    picked = df.where(F.col(day).isNotNull()).groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in df.columns if c not in keys])


def one_per_subject_wave(df: DataFrame, key: str, cuts: Mapping[str, int] = CUTS, **options) -> DataFrame:
    """``one_per_subject`` inside every window."""
    return one_per_subject(split_waves(df, cuts, options.get("day", "day")), ["wave", key], **options)


def drop_dups(df: DataFrame, key: str, order: str, keep: str | bool = False) -> DataFrame:
    """Keep the first row of each key, or with ``keep=False`` drop every copy of a repeated key."""
    rest = [c for c in df.columns if c not in (key, order)]
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(order, *rest)).alias("_first")
    )
    kept = grouped if keep == "first" else grouped.where(F.col("_n") == 1)
    return kept.select(*[key if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def first_entry(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """First non-null value of each column per key, in the given order."""
    return df.groupBy(key).agg(
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in cols]
    )


def rolling_mean(df: DataFrame, y: str, window: int, by: Sequence[str], day: str = "day", tiebreak: str = "visit_id",
                 out: str = "smoothed", block: int = 65536) -> DataFrame:
    """Mean of the last ``window`` rows by day (nulls skipped, at least one row).

    Groups are cut into blocks of consecutive rows. The last ``window - 1`` rows of a block are
    also sent to the next block, so every window is complete inside one task of bounded size.
    """
    by = list(by)
    block = max(block, window)
    indexed = row_index(df, day, tiebreak, "_idx", by)
    own = F.floor(F.col("_idx") / block)
    near_end = F.col("_idx") % block >= block - (window - 1)
    spread = F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    frame = Window.partitionBy(*by, "_block").orderBy("_idx").rowsBetween(-(window - 1), 0)
    return (
        indexed.withColumn("_own", own)
        .withColumn("_block", spread)
        .withColumn(out, F.avg(y).over(frame))
        .where(F.col("_block") == F.col("_own"))
        .drop("_idx", "_own", "_block")
    )


def daily(df: DataFrame, y: str, by: Sequence[str], day: str = "day") -> DataFrame:
    """Rows per (group, day) with counts and sums: its size depends on days, not on rows."""
    return df.where(F.col(day).isNotNull()).groupBy(*by, day).agg(
        F.count(F.lit(1)).alias("n"), F.count(y).alias("n_y"), F.sum(y).alias("sum_y")
    )


def _timepoints(df: DataFrame, timepoints: Sequence[int]) -> DataFrame:
    return df.withColumn("timepoint", F.explode(F.array(*[F.lit(t) for t in timepoints])))


def point_avg(df: DataFrame, y: str, timepoints: Sequence[int], delta: int, by: Sequence[str], day: str = "day") -> DataFrame:
    """Mean day and mean y of the rows with day in [t - delta, t + delta) for every timepoint."""
    points = _timepoints(daily(df, y, by, day), timepoints)
    inside = points.where((F.col(day) >= F.col("timepoint") - delta) & (F.col(day) < F.col("timepoint") + delta))
    return inside.groupBy(*by, "timepoint").agg(
        (F.sum(F.col(day) * F.col("n")) / F.sum("n")).alias("mean_day"),
        F.try_divide(F.sum("sum_y"), F.sum("n_y")).alias("mean_y"),
    )


def point_avg_balanced(df: DataFrame, y: str, timepoints: Sequence[int], delta: int, by: Sequence[str],
                       day: str = "day") -> DataFrame:
    """Mean y near each midpoint, in a band as wide as the smaller of the two side counts.

    The count of rows is used as a width in days. If that band has no value, the full band is used.
    """
    points = _timepoints(daily(df, y, by, day), timepoints)
    d, t = F.col(day), F.col("timepoint")
    full = d.between(t - delta, t + delta)
    sides = points.groupBy(*by, "timepoint").agg(
        F.coalesce(F.sum(F.when(full & (d < t), F.col("n"))), F.lit(0)).alias("_left"),
        F.coalesce(F.sum(F.when(full & (d > t), F.col("n"))), F.lit(0)).alias("_right"),
    )
    width = F.least("_left", "_right")
    near = d.between(t - width, t + width)
    joined = points.join(sides, [*by, "timepoint"])
    means = joined.groupBy(*by, "timepoint").agg(
        F.try_divide(F.sum(F.when(near, F.col("sum_y"))), F.sum(F.when(near, F.col("n_y")))).alias("_near"),
        F.try_divide(F.sum(F.when(full, F.col("sum_y"))), F.sum(F.when(full, F.col("n_y")))).alias("_full"),
    )
    return means.select(*by, t.alias("day"), F.coalesce("_near", "_full").alias("mean_y"))


def pad_groups(df: DataFrame, key: str, n: int, out: str = "slot") -> DataFrame:
    """Add empty rows until every group has at least ``n`` rows; ``slot`` marks the added ones."""
    short = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < n)
    extra = short.select(key, F.explode(F.sequence(F.col("_n").cast("int") + 1, F.lit(n))).alias(out))
    return df.withColumn(out, F.lit(None).cast("int")).unionByName(extra, allowMissingColumns=True)
