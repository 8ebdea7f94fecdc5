"""Descriptive tables: partial aggregates first, small results after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.functions import dist
from armwave.operators.ordering import exact_percentiles


def summary(df: DataFrame, by: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Mean, sample SD and count of every outcome per group, one row per outcome."""
    long = melt(df, by, ys, "outcome", "value") if len(ys) > 1 else df.select(
        *by, F.lit(ys[0]).alias("outcome"), F.col(ys[0]).alias("value"))
    return long.groupBy(*by, "outcome").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n")
    )


def summary_text(df: DataFrame, by: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """``mean (sd) [n]`` as text with two decimals; nan where there are too few values."""
    s = summary(df, by, ys)
    two = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", c)).otherwise("nan")
    return s.select(*by, "outcome", F.format_string("%s (%s) [%d]", two("mean"), two("sd"), F.col("n")).alias("cell"))


def summary_cont(df: DataFrame, by: Sequence[str], y: str, level: float = 0.95) -> DataFrame:
    """N, mean, SD, SE and a t interval per group.

    The t quantile depends on N only; it is looked up once per distinct N in Arrow batches.
    """
    quantile = dist.t_ppf

    @F.pandas_udf("double")
    def critical(n: pd.Series) -> pd.Series:
        table = {k: quantile(0.5 + level / 2, k - 1) if k > 1 else None for k in n.dropna().unique()}
        return n.map(table).astype("float64")

    stats = df.groupBy(*by).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd")
    ).withColumn("se", F.try_divide(F.col("sd"), F.sqrt("n")))
    half = critical(F.col("n")) * F.col("se")
    return stats.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def value_counts(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    df = df.where(where) if where is not None else df
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def multi_count(df: DataFrame, key: str, out: str = "n_multi") -> DataFrame:
    """Number of keys with more than one row."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.count_if(F.col("_n") > 1).alias(out))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Number of groups and the largest group size."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.max("_n").alias("max_size"))


def dense_counts(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """Counts for every observed row key and every value of ``col``; missing pairs count 0."""
    wide = df.groupBy(*rows).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))
    return wide.unpivot(list(rows), list(values), col, "count")


def pivot_mean(df: DataFrame, index: str, col: str, values: Sequence, val: str) -> DataFrame:
    return df.groupBy(index).pivot(col, list(values)).agg(F.avg(val))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def histogram(df: DataFrame, x: str, edges: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Counts per bin; bins are closed on the left and the last bin is closed on both sides."""
    last = len(edges) - 2
    bins = None
    for i in range(last + 1):
        inside = (F.col(x) >= edges[i]) & ((F.col(x) <= edges[i + 1]) if i == last else (F.col(x) < edges[i + 1]))
        bins = F.when(inside, i) if bins is None else bins.when(inside, i)
    return (
        df.withColumn("bin", bins).where(F.col("bin").isNotNull())
        .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """Count, min, quartiles, max per group, exact also for very large groups."""
    ends = df.where(F.col(y).isNotNull()).groupBy(*by).agg(
        F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"))
    return ends.join(exact_percentiles(df, y, (0.25, 0.5, 0.75), by, ("q1", "median", "q3")), list(by))


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "n")


def n_subjects(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(key).alias("n_subjects"))


def bounds(df: DataFrame, label: str, x: str) -> DataFrame:
    return df.groupBy(label).agg(F.min(x).alias("low"), F.max(x).alias("high"))


def mean_vector(df: DataFrame, key: str, vec: str, size: int) -> DataFrame:
    """Elementwise mean of arrays of a known length: plain averages that combine on the map side."""
    means = df.groupBy(key).agg(*[F.avg(F.get(vec, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)])
    return means.select(key, F.array(*[f"_{i}" for i in range(size)]).alias(vec))


def cv_summary(scores: DataFrame, by: Sequence[str], score: str, params: str) -> DataFrame:
    """Mean and population SD of fold scores, and the most common parameter text (first on ties)."""
    stats = scores.groupBy(*by).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("sd_score"))
    counts = scores.groupBy(*by, params).agg(F.count(F.lit(1)).alias("_n"))
    common = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("_o"), params))[params].alias(params))
    return stats.join(common, list(by)) if by else stats.withColumn("_k", F.lit(0)).join(
        common.withColumn("_k", F.lit(0)), "_k").drop("_k")


def arm_means(df: DataFrame, by: Sequence[str], y: str, arm: str = "arm", order: Sequence[str] = ("C", "M", "P", "L")) -> DataFrame:
    """Mean of one outcome per arm in a fixed arm order."""
    return df.groupBy(*by).pivot(arm, list(order)).agg(F.avg(y))


def band_by_day(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
