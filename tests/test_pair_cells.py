"""Value pairs counted in tasks against plain counting: nulls, keys, few held cells, and what is left to shuffle."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from armwave.operators import audit

COLS = ["a", "b", "key", "none", "c d"]


def table(spark, n, parts):
    df = spark.range(n, numPartitions=parts)
    return df.select(F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("a"), F.concat(F.lit("x"), (F.col("id") % 7).cast("string")).alias("b"), F.col("id").alias("key"),
                     F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, F.lit("")).alias("c d"), F.lit(1).alias("n"))


@pytest.mark.parametrize("held", [audit.CELLS, 50])
def test_counts(spark, held):
    df = table(spark, 3000, 2)
    got = audit.pair_cells(df, COLS, held).groupBy("left", "right", "a", "b").agg(F.sum("n").alias("n")).collect()
    want = Counter()
    for r in df.collect():
        for i, x in enumerate(COLS):
            for y in COLS[i + 1:]:
                if r[x] is not None and r[y] is not None:
                    want[x, y, str(r[x]), str(r[y])] += 1
    assert {tuple(r)[:4]: r.n for r in got} == dict(want)


def test_cells_do_not_grow_with_rows(spark):
    """Ten times the rows give the same number of partial counts."""
    sizes = [audit.pair_cells(table(spark, n, 4), ["a", "b", "c d"]).count() for n in (20_000, 200_000)]
    assert sizes[0] == sizes[1] == 4 * (3 * 7 + 3 + 7)


def test_empty_and_single(spark):
    assert audit.pair_cells(table(spark, 10, 1).limit(0), COLS).count() == 0
    assert audit.pair_cells(table(spark, 10, 1), ["a"]).count() == 0
    assert audit.top_assoc(table(spark, 100, 2), ["a", "none"], 3).count() == 0
