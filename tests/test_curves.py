"""Curves against direct computations on single rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from armwave.operators import curves, waves


def direct_lowess(x, y, frac, rounds):
    n = len(x)
    k = int(frac * n + 1e-10)
    w = np.ones(n)
    for step in range(rounds + 1):
        fit = np.empty(n)
        for i in range(n):
            gap = np.abs(x - x[i])
            h = np.sort(gap)[k - 1]
            u = gap / h if h > 0 else np.where(gap == 0, 0.0, 2.0)
            a = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - np.clip(u, 0, 1) ** 3) ** 3, 0.0)) * w
            c = (a * x).sum() / a.sum()
            s = (a * (x - c) ** 2).sum() / a.sum()
            fit[i] = (a * y).sum() / a.sum()
            if s > (0.001 * (x.max() - x.min())) ** 2:
                fit[i] += (x[i] - c) * (a * y * (x - c)).sum() / a.sum() / s
        r = np.abs(y - fit)
        u = r / (6 * np.median(r))
        w = np.where(u < 0.001, 1.0, np.where(u > 0.999, 0.0, (1 - u * u) ** 2))
    return fit


def test_lowess_equals_fit_on_rows(spark):
    rng = np.random.default_rng(2)
    day = np.sort(rng.integers(0, 60, 300))
    y = np.sin(day / 12) + rng.normal(scale=0.3, size=300)
    y[::37] += 6
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "day": day, "y": y})).repartition(5)
    for rounds in (0, 2):
        got = curves.lowess(df, "y", 0.3, ["g"], robust=rounds).toPandas().set_index("day")["smoothed"]
        want = pd.Series(direct_lowess(day.astype(float), y, 0.3, rounds), index=day).groupby(level=0).first()
        np.testing.assert_allclose(got.reindex(want.index.astype(float)).to_numpy(), want.to_numpy(), atol=1e-8)
    assert curves.lowess(df.drop("g"), "y", 0.3, robust=0).columns == ["day", "smoothed"]


def test_quadratic_matches_least_squares(spark):
    x, y = np.array([1.0, 100, 250, 400, 500]), np.array([3.0, 2.0, 1.5, 1.7, 2.2])
    points = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)] + [("few", 1.0, 1.0), ("few", 2.0, 2.0)], "g string, day double, mean_y double")
    got = curves.poly2(points, ["g"]).orderBy("step").toPandas()
    assert set(got.g) == {"a"} and len(got) == 100
    np.testing.assert_allclose(got.smoothed, np.polyval(np.polyfit(x, y, 2), np.linspace(1, 500, 100)), atol=1e-9)


def test_exponential_fit(spark):
    t = np.array([0.0, 50, 100, 200, 400])
    rows = [("a", float(v), float(2.5 * np.exp(-0.01 * v) + 0.7)) for v in t] + [("b", float(v), float(1.2 * np.exp(-0.004 * v))) for v in t] + [("few", 1.0, 1.0)]
    points = spark.createDataFrame(rows, "g string, day double, mean_y double")
    got = {r["g"]: r for r in curves.exp_fit(points.where("g <> 'b'"), ["g"], start=(1.0, 0.02, 1.0)).collect()}
    assert abs(got["a"]["a"] - 2.5) < 1e-5 and abs(got["a"]["b"] - 0.01) < 1e-7 and abs(got["a"]["c"] - 0.7) < 1e-5
    assert got["few"]["a"] is None
    two = curves.exp_fit(points.where("g = 'b'"), ["g"], offset=False).first()
    assert abs(two["a"] - 1.2) < 1e-6 and abs(two["b"] - 0.004) < 1e-8 and two["c"] is None


def test_balanced_average_falls_back_to_the_full_band(spark):
    df = spark.createDataFrame([("a", 90, 1.0), ("a", 95, 2.0), ("a", 99, 3.0), ("b", 95, 1.0), ("b", 99, 2.0), ("b", 101, 4.0), ("b", 130, 9.0)], "g string, day int, y double")
    got = {r["g"]: r["mean_y"] for r in waves.point_avg_balanced(df, "y", [100], 45, ["g"]).collect()}
    assert got["a"] == 2.0  # nothing on the right: band of width 0 is empty, so the full band counts
    assert got["b"] == 3.0  # two on the left, two on the right: days 98 to 102


def test_curve_table_has_every_kind(spark):
    df = spark.range(400).select(F.col("id").alias("visit_id"), (F.col("id") % 2).alias("arm"), (F.col("id") % 97 * 4).cast("int").alias("day"), (F.col("id") % 13).cast("double").alias("y"))
    got = curves.curve_table(df, "y", [50, 150, 250, 350], 45, 10, ["arm"])
    assert {r["kind"] for r in got.select("kind").distinct().collect()} == {"poly", "mov_av", "smooth"}
