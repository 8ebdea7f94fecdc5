"""Order-dependent operators that never put a whole group into one task.

A window ordered inside a group sends the group to a single task, which fails when one group holds
a third of the rows. ``running_sum`` instead range-partitions the rows by (group, order, tie-break),
which are unique together, so that a group, or a value that many rows share, is cut like any other run
of rows. The rows are written once with their range's number; sums per (group, range) are few, so their
prefix sums are cheap, and the window runs inside one range only. The input is read for the ranges'
sample and once more; keys may be of any type that sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwave.session import scratch_path


def _known(df: DataFrame, col: str) -> Column:
    """Neither null nor NaN: both are missing values."""
    kind = dict(df.dtypes)[col]
    return F.col(col).isNotNull() & ~F.isnan(col) if kind in ("double", "float") else F.col(col).isNotNull()


def ranges(df: DataFrame, *keys: str, out: str = "_cell") -> DataFrame:
    """The rows in ranges of the keys, written to the shared folder; ``out`` numbers the ranges in key order."""
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*keys).withColumn(out, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running_sum(
    df: DataFrame,
    order: str,
    tiebreak: str,
    out: str = "start",
    by: Sequence[str] = (),
    weight: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all earlier rows of the group (exclusive prefix).

    ``total`` names a further column with the sum over the whole group, from the same range totals.
    ``order`` and ``tiebreak`` together are unique inside a group; nulls sort first. Null groups are groups.
    """
    by = list(by)
    weight = F.lit(1) if weight is None else weight
    celled = ranges(df.withColumn("_cell_w", weight.cast("long")), *dict.fromkeys([*by, order, tiebreak]))
    totals = celled.groupBy(*by, "_cell").agg(F.sum("_cell_w").alias("_cell_total"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_cell_total").over(Window.partitionBy(*by)).alias(total)] if total else []
    names = [f"_cell_by{i}" for i in range(len(by))]
    offsets = totals.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_cell").alias("_cell_at"),
                            F.coalesce(F.sum("_cell_total").over(before), F.lit(0)).alias("_cell_offset"), *whole)
    match = F.col("_cell") == F.col("_cell_at")
    for c, n in zip(by, names):
        match = match & F.col(c).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*by, "_cell").orderBy(order, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    return (
        celled.join(offsets, match)
        .withColumn(out, F.col("_cell_offset") + F.coalesce(F.sum("_cell_w").over(inside), F.lit(0)))
        .drop("_cell", "_cell_at", "_cell_w", "_cell_offset", *names)
    )


def row_index(df: DataFrame, order: str, tiebreak: str, out: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """Zero-based position of each row inside its group, ordered by ``order`` then ``tiebreak``."""
    return running_sum(df, order, tiebreak, out, by)


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per group, from value counts instead of a collected group."""
    by = list(by)
    keep = by
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    names = list(names or [f"p{round(p * 1000)}" for p in probs])
    counts = (
        df.where(_known(df, value))
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    spans = running_sum(counts, "_v", "_v", "_start", by, F.col("_n"), total="_total")
    picks = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    found = spans.groupBy(*by).agg(*picks)
    return found.select(
        *keep,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
            for n in names
        ],
    )


def rank_avg(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Rank with ties averaged. Ties are counted first, so a hot value is one row when ranked."""
    by = list(by)
    counts = df.where(_known(df, value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_sum(counts, value, value, "_start", by, F.col("_n")).select(
        *by, value, (F.col("_start") + (F.col("_n") + 1) / F.lit(2.0)).alias(out)
    )
    return df.join(ranks, [*by, value], "left")


def sort_rows(df: DataFrame, *order) -> DataFrame:
    """Total order: a range-partitioned sort."""
    return df.orderBy(*order)


def head_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows in the given order (each task keeps ``n`` rows)."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, col: str, k: int, tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(tiebreak)).limit(k)


def first_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` smallest keys. The key list has at most ``n`` rows, so it is broadcast."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")


def best_rows(df: DataFrame, col: str) -> DataFrame:
    """All rows that hold the maximum (ties kept)."""
    best = df.agg(F.max(col).alias("_best"))
    return df.join(F.broadcast(best), F.col(col) == F.col("_best"), "inner").drop("_best")


def nth_row(df: DataFrame, i: int, *order) -> DataFrame:
    """The row at zero-based position ``i``."""
    return df.orderBy(*order).offset(i).limit(1)


def drop_last(df: DataFrame, n: int, order: str) -> DataFrame:
    """Remove the ``n`` rows with the largest ``order`` (unique). At most ``n`` keys are broadcast."""
    last = df.select(order).orderBy(F.col(order).desc()).limit(n)
    return df.join(F.broadcast(last), order, "left_anti")


def first_match(df: DataFrame, col: str, value, order: str, cond: Column | None = None, out: str = "first_index") -> DataFrame:
    """Smallest ``order`` among rows where ``col`` equals ``value`` (and ``cond`` holds)."""
    hit = F.col(col) == F.lit(value)
    hit = hit & cond if cond is not None else hit
    return df.where(hit).agg(F.min(order).alias(out))
