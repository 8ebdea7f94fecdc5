"""Order-dependent operators against pandas, with one hot group and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armwave.operators import ordering, waves


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows: half of them in one group, a third of them on one day."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "visit_id": rng.permutation(n), "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcde"), n)),
        "day": np.where(rng.random(n) < 0.33, 0, rng.integers(-5, 400, n)), "y": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n).round(2))})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(7)
    return pdf, df


def test_row_index_is_exact(hot):
    pdf, df = hot
    got = ordering.row_index(df, "day", "visit_id", "idx", ["g"]).toPandas().set_index("visit_id")["idx"].sort_index()
    want = pdf.sort_values(["day", "visit_id"]).assign(idx=lambda d: d.groupby("g").cumcount()).set_index("visit_id")["idx"].sort_index()
    assert (got == want).all() and len(got) == len(pdf)


def test_running_sum_without_groups(hot):
    pdf, df = hot
    got = ordering.running_sum(df, "day", "visit_id", "start", (), F.lit(3)).toPandas().set_index("visit_id")["start"].sort_index()
    want = pdf.sort_values(["day", "visit_id"]).assign(start=lambda d: np.arange(len(d)) * 3).set_index("visit_id")["start"].sort_index()
    assert (got == want).all()


@pytest.mark.parametrize("window,block", [(5, 8), (50, 64), (50, 10_000), (1, 16)])
def test_rolling_mean(hot, window, block):
    pdf, df = hot
    got = waves.rolling_mean(df, "y", window, ["g"], block=block).toPandas().set_index("visit_id")["smoothed"].sort_index()
    want = (pdf.sort_values(["day", "visit_id"]).groupby("g").apply(
        lambda d: d.assign(s=d["y"].rolling(window, min_periods=1).mean()), include_groups=False).set_index("visit_id")["s"].sort_index())
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True, atol=1e-9)
    assert len(got) == len(pdf)


def test_exact_percentiles(hot):
    pdf, df = hot
    got = ordering.exact_percentiles(df, "y", (0.025, 0.5, 0.9), ["g"], ("a", "b", "c")).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["y"].quantile([0.025, 0.5, 0.9]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy(), atol=1e-12)
    whole = ordering.exact_percentiles(df, "day", (0.5,)).first()
    assert whole[0] == np.percentile(pdf["day"], 50)


def test_text_keys_and_nulls(hot):
    pdf, df = hot
    named = df.withColumn("visit_id", F.format_string("S%05d", "visit_id")).withColumn("g", F.when(F.col("g") != "a", F.col("g")))
    got = ordering.row_index(named, "day", "visit_id", "idx", ["g"]).toPandas().set_index("visit_id")["idx"].sort_index()
    want = pdf.sort_values(["day", "visit_id"]).assign(idx=lambda d: d.groupby("g").cumcount()).set_index("visit_id")["idx"].sort_index()
    assert (got.to_numpy() == want.to_numpy()).all() and len(got) == len(pdf)


def test_adjacent_hot_ids_are_cut(spark):
    """A value with a third of the rows and neighbouring ids is cut like any other range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(30000).select("id", F.when(F.col("id").between(10000, 19999), 7).otherwise(F.col("id") % 5000 + 10).alias("v"))
        sizes = [r["count"] for r in ordering.ranges(df, "v", "id").groupBy("_cell").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 2 * 30000 / len(sizes)


def test_input_is_read_at_most_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(2000).mapInArrow(count, "id long")
    assert ordering.row_index(df, "id", "id").where("idx <> id").count() == 0
    assert seen.value <= 2 * 2000


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert ordering.exact_percentiles(df, "v", (0.5,)).first()[0] == 2.0
    assert sorted(r["rank"] for r in ordering.rank_avg(df, "v").collect() if r["rank"] is not None) == [1.0, 2.0]


def test_rank_avg(hot):
    pdf, df = hot
    got = ordering.rank_avg(df, "day", by=["g"]).toPandas().set_index("visit_id")["rank"].sort_index()
    want = pdf.assign(r=pdf.groupby("g")["day"].rank()).set_index("visit_id")["r"].sort_index()
    assert (got == want).all()


def test_one_row_per_subject_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, 10, 0, None), (1, 11, 0, 2.0), (1, 12, 5, 3.0), (2, 20, 7, 1.0), (3, 30, 1, None), (3, 31, 9, 4.0)],
        "subject long, visit_id long, day int, score double")
    first = {r["subject"]: r["visit_id"] for r in waves.one_per_subject(df, "subject").collect()}
    assert first == {1: 10, 2: 20, 3: 30}
    last = {r["subject"]: r["visit_id"] for r in waves.one_per_subject(df, "subject", "max", lower=4).collect()}
    assert last == {1: 12, 2: 20, 3: 31}
    known = {r["subject"]: r["score"] for r in waves.first_entry(df, "subject", "visit_id", ["score"]).collect()}
    assert known == {1: 2.0, 2: 1.0, 3: 4.0}
    assert [r["subject"] for r in waves.drop_dups(df, "subject", "visit_id").collect()] == [2]
    assert sorted(r["visit_id"] for r in waves.drop_dups(df, "subject", "visit_id", "first").collect()) == [10, 20, 30]


def test_windows_are_cumulative(spark):
    df = spark.createDataFrame([(0,), (45,), (46,), (318,), (499,), (500,), (None,)], "day int")
    got = waves.split_waves(df).groupBy("day").agg(F.sort_array(F.collect_list("wave")).alias("w")).collect()
    assert {r["day"]: r["w"] for r in got} == {
        0: ["14", "24", "36", "b"], 45: ["14", "24", "36", "b"], 46: ["14", "24", "36"], 318: ["24", "36"], 499: ["36"]}


def test_padding(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 1), ("c", 1), ("c", 1), ("c", 1)], "k string, v int")
    sizes = {r["k"]: r["n"] for r in waves.pad_groups(df, "k", 3).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"a": 3, "b": 3, "c": 4}
