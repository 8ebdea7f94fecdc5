"""Joins and set operations on explicit keys.

No join here forces a broadcast of data whose size grows with the input: Spark picks the strategy
from statistics, and adaptive execution splits skewed partitions of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def attach_arm(df: DataFrame, arms: DataFrame, key: str = "subject") -> DataFrame:
    """Inner join to the arm table (one row per subject)."""
    return df.join(arms, key, "inner")


def join_left(out: DataFrame, pred: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return out.join(pred, _key(key), "left")


def outer_all(dfs: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """Full outer join of several sources; the key is coalesced over the sources."""
    return reduce(lambda a, b: a.join(b, _key(key), "full"), dfs)


def join_all(dfs: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, _key(key), "inner"), dfs)


def join_inner(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b, _key(key), "inner")


def semi(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b.select(*_key(key)), _key(key), "left_semi")


def anti(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b.select(*_key(key)), _key(key), "left_anti")


def overlap_count(a: DataFrame, b: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b``; duplicates in ``a`` are counted."""
    return semi(a, b, key).agg(F.count(F.lit(1)).alias(out))


def fill_cells(table: DataFrame, rules: Sequence[tuple[str, str | None]], values: DataFrame, text: str, rater: str | None,
               keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Fill result cells by label: a table row takes the values of the first rule it matches.

    ``rules`` pairs a piece of text with an outcome name; a row belongs to the first outcome whose
    piece its ``text`` contains. The outcome then joins ``values`` on ``keys`` (an equi join, so no
    nested loop over rows), and new values win over stored ones.
    """
    outcome = F.coalesce(*[F.when(F.col(text).contains(piece), F.lit(name)) for piece, name in rules])
    fresh = values.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cells])
    joined = table.withColumn("outcome", outcome).join(fresh, list(keys), "left")
    filled = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in table.columns else F.col(f"_new_{c}") for c in cells}
    return joined.withColumns(filled).drop(*[f"_new_{c}" for c in cells])


def pair_raters(df: DataFrame, rater: str, a, b, key: str, values: Sequence[str], order: str) -> DataFrame:
    """One row per subject rated by both raters: ``<value>_a`` and ``<value>_b``.

    The first row (by ``order``) of each rater is used. One aggregation instead of a self join.
    """
    picks = []
    for tag, who in (("a", a), ("b", b)):
        first = F.min(F.when(F.col(rater) == F.lit(who), F.struct(order, *values)))
        picks.append(first.alias(tag))
    pairs = df.where(F.col(rater).isin([a, b])).groupBy(key).agg(*picks)
    return pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        key, *[F.col(f"{tag}.{v}").alias(f"{v}_{tag}") for v in values for tag in ("a", "b")]
    )


def reconcile(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """Full join of two sources with an ``agrees`` flag (null-safe)."""
    left = a.select(key, F.col(col).alias(f"{col}_a"))
    right = b.select(key, F.col(col).alias(f"{col}_b"))
    return left.join(right, key, "full").withColumn("agrees", F.col(f"{col}_a").eqNullSafe(F.col(f"{col}_b")))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def zip_cols(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Column concat aligned on an explicit key."""
    return a.join(b, _key(key), "inner")


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def grid(df: DataFrame, options: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the option lists for each row, by exploding literal arrays."""
    out = df
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def same_row(a: str, b: str, cols: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
