"""Comparing two sides block by block, when neither side fits a broadcast."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.session import cut_lineage


def block_pairs(left: DataFrame, right: DataFrame, cell: str, left_key: Sequence[str], right_key: Sequence[str],
                compare: Callable, schema: str, left_rows: int, right_rows: int) -> DataFrame:
    """``compare(left block, right block)`` for every pair of blocks inside a cell.

    Each side of a cell is cut by a hash of its key into blocks of about the given number of rows,
    and a block is sent once to every block of the other side. So a crowded cell is many small
    groups, nothing passes through the driver, and no pair of rows is ever a row. Right columns
    arrive with the prefix ``o_``.
    """
    sizes = left.groupBy(cell).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(cell).agg(F.count(F.lit(1)).alias("_r")), cell)
    sizes = cut_lineage(sizes.select(
        cell, F.ceil(F.col("_l") / left_rows).cast("int").alias("_l"), F.ceil(F.col("_r") / right_rows).cast("int").alias("_r")))

    def cut(df, key, own, other, mine, theirs):
        part = F.pmod(F.xxhash64(*key), F.col(own)).cast("int").alias(mine)
        return df.join(sizes, cell).select(*df.columns, part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    a = cut(left, left_key, "_l", "_r", "_lb", "_rb")
    b = cut(right, right_key, "_r", "_l", "_rb", "_lb")
    b = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
    return a.groupBy(cell, "_lb", "_rb").cogroup(b.groupBy(f"o_{cell}", "o__lb", "o__rb")).applyInPandas(compare, schema)
