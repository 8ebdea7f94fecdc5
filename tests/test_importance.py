"""Importance by leaf sets against the version that copies vectors, and leaf sets against Spark's own predictions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from armwave.operators import importance, models

ESTIMATORS = {
    "tree": lambda: DecisionTreeRegressor(maxDepth=5),
    "forest": lambda: RandomForestRegressor(numTrees=7, maxDepth=9, seed=3),  # more than 64 leaves
    "boosted": lambda: GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.3),
}


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.ml.feature import StringIndexer

    raw = spark.range(900).select(
        "id", (F.col("id") * 7919 % 101 / 10.0).alias("a"), (F.col("id") * 31 % 17 / 3.0).alias("b"), (F.col("id") * 13 % 7).cast("string").alias("text"),
        (F.col("id") % 2).cast("double").alias("flag"), F.lit(1.0).alias("same"))
    coded = StringIndexer(inputCol="text", outputCol="code").fit(raw).transform(raw)
    label = F.col("a") * F.col("b") + F.when(F.col("code").isin(1, 4, 5), 9.0).otherwise(F.col("a")) + F.col("flag")
    made = VectorAssembler(inputCols=["a", "b", "code", "flag", "same"], outputCol="features").transform(coded)
    return made.select("id", label.alias("label"), "features")


@pytest.mark.parametrize("kind", list(ESTIMATORS))
def test_leaf_sets_predict_as_the_model(spark, rows, kind):
    model = ESTIMATORS[kind]().fit(rows)
    got = model.transform(rows).select(vector_to_array("features").alias("x"), "prediction").toPandas()
    x = np.array(got.x.tolist())
    x[5, 0] = np.nan
    trees = importance.stored_trees(spark, model)
    partner = x[np.random.default_rng(4).permutation(len(x))]
    total, changed = importance.predictions(trees, x, partner)
    keep = np.arange(len(x)) != 5
    np.testing.assert_allclose(total[keep], got.prediction[keep], rtol=1e-12)
    for f, values in changed.items():
        swapped = x.copy()
        swapped[:, f] = partner[:, f]
        again = spark.createDataFrame([(v.tolist(),) for v in swapped[keep]], "v array<double>").select(array_to_vector("v").alias("features"))
        np.testing.assert_allclose(values[keep], model.transform(again).toPandas().prediction, rtol=1e-12)
    assert kind != "forest" or max(t.words for t in trees) > 1
    assert any(isinstance(c, importance.Codes) for t in trees for c in t.features.values())


@pytest.mark.parametrize("kind", list(ESTIMATORS))
def test_same_as_copied_vectors(spark, rows, kind, monkeypatch):
    monkeypatch.setattr(importance, "WORDS", 1000)  # rows in parts
    model = ESTIMATORS[kind]().fit(rows)
    want = models.perm_importance(rows, model, 5, "id", repeats=3).toPandas().set_index("feature").sort_index()
    got = importance.shuffled_drop(rows.repartition(5), model, 5, "id", repeats=3).toPandas().set_index("feature").sort_index()
    assert list(got.index) == [0, 1, 2, 3, 4] and got.importance[4] == 0
    np.testing.assert_allclose(got.importance, want.importance, atol=1e-10)
    np.testing.assert_allclose(got.sd, want.sd, atol=1e-8)


def test_one_row_a_repeat_meets_the_trees(spark, rows):
    model = ESTIMATORS["tree"]().fit(rows)
    trees, seen = importance.stored_trees(spark, model), []
    real = importance.predictions
    x = np.array([r.x for r in rows.select(vector_to_array("features").alias("x")).collect()])
    import pyarrow as pa

    def counted(t, a, b):
        seen.append(len(a))
        return real(t, a, b)

    importance.predictions = counted
    try:
        batch = pa.RecordBatch.from_pydict({"repeat": pa.array([0] * len(x), pa.int32()), "_y": pa.array(np.zeros(len(x))), "_x": pa.array(x.tolist()), "_p": pa.array(x.tolist())})
        (sums,) = importance._error_sums(trees, 5, 2)(iter([batch]))
    finally:
        importance.predictions = real
    assert seen == [len(x)] and sums.num_rows == 6  # five features and the plain line, one repeat seen


def test_odd_rows(spark, rows):
    model = ESTIMATORS["tree"]().fit(rows)
    assert importance.shuffled_drop(rows.where("id < 0"), model, 5, "id").count() == 0
    extra = rows.withColumns({"_k": F.lit("x"), "repeat": F.lit(9), "feature": F.lit(1), "n": F.lit(0)}).unionByName(
        spark.createDataFrame([(10_000, None)], "id long, label double").withColumns(
            {"features": F.lit(None).cast(rows.schema["features"].dataType), "_k": F.lit("y"), "repeat": F.lit(1), "feature": F.lit(2), "n": F.lit(1)}))
    want = importance.shuffled_drop(rows, model, 5, "id", repeats=2).toPandas().sort_values("feature")
    got = importance.shuffled_drop(extra, model, 5, "id", repeats=2).toPandas().sort_values("feature")
    np.testing.assert_allclose(got.importance, want.importance, atol=1e-10)
    equal = importance.shuffled_drop(rows.withColumn("label", F.lit(1.0)), model, 5, "id", repeats=2).toPandas()
    assert equal.importance.isna().all()


def test_rows_of_equal_codes_meet_the_trees_once(spark, rows, monkeypatch):
    """However many rows there are, the trees are asked for distinct codes only, and rows are shuffled as two bytes a tested feature."""
    import pyarrow as pa

    model = ESTIMATORS["forest"]().fit(rows)
    trees, asked = importance.stored_trees(spark, model), []
    real = importance.first_set
    monkeypatch.setattr(importance, "first_set", lambda sets: asked.append(len(sets)) or real(sets))
    x = np.array([r.x for r in rows.select(vector_to_array("features").alias("x")).collect()])
    rng = np.random.default_rng(5)
    work = []
    for times in (1, 8):
        wide = np.tile(x, (times, 1))
        batch = pa.RecordBatch.from_pydict({"repeat": pa.array(np.zeros(len(wide), np.int32)), "_y": pa.array(np.zeros(len(wide))), "_x": pa.array(wide.tolist()), "_p": pa.array(wide.tolist())})
        asked.clear()
        (sums,) = importance._error_sums(trees, 5, 1)(iter([batch]))
        work.append((sum(asked), sums.column("n").to_pylist()[0]))
    assert work[0][0] == work[1][0] and work[1][1] == 8 * work[0][1]
    coded = importance.Coded(trees)
    some = x[rng.permutation(len(x))]
    some[:3, 0] = np.inf, -np.inf, np.nan
    a, b = importance.predictions(trees, x, some), importance.predictions(coded, coded.of(x), coded.of(some))
    np.testing.assert_array_equal(a[0], b[0])
    for f in a[1]:
        np.testing.assert_array_equal(a[1][f], b[1][f])


@pytest.fixture(scope="module")
def grown(spark, rows):
    """A forest of depth 4 on two of three parts, grown whole, from sums per cell and by passes."""
    from armwave.operators import growing

    table = growing.binned(rows.withColumn("fold", (F.col("id") % 3).cast("int")), "id")
    model = [growing.Model(0, growing.forest({"n_estimators": 6, "max_depth": 4}), 0, 0)]
    ways = {"whole": {}, "cells": {"local": 20, "by_cells": True}, "passes": {"local": 100}}
    return table, {way: growing.fit(table, model, keep=True, **options) for way, options in ways.items()}


@pytest.mark.parametrize("way", ["whole", "cells", "passes"])
def test_kept_trees_predict_as_the_forest(spark, rows, grown, way):
    table, fitted = grown
    x = np.array([r.x for r in rows.where("id % 3 = 0").select(vector_to_array("features").alias("x")).collect()])
    y = np.array([r.label for r in rows.where("id % 3 = 0").select("label").collect()])
    trees = importance.grown_trees(fitted[way].trees(0), table.cuts[0])
    assert len(trees) == 6 and max(len(t.values) for t in trees) <= 16
    total, changed = importance.predictions(trees, x, x[::-1])
    np.testing.assert_allclose(((y - total) ** 2).mean(), fitted[way].scores().first().mse, rtol=1e-6)
    for f, values in changed.items():
        swapped = x.copy()
        swapped[:, f] = x[::-1, f]
        np.testing.assert_array_equal(values, importance.predictions(trees, swapped, swapped)[0])


def test_importance_of_a_grown_forest(spark, rows, grown):
    table, fitted = grown
    trees = importance.grown_trees(fitted["whole"].trees(0), table.cuts[0])
    got = importance.shuffled_drop(rows.where("id % 3 = 0"), trees, 5, "id", repeats=2).toPandas().set_index("feature").importance
    assert list(got.sort_values().index)[-2:] == [1, 0] and got[4] == 0


def test_trees_are_kept_of_forests_only(grown):
    from armwave.operators import growing

    with pytest.raises(ValueError, match="forests"):
        growing.fit(grown[0], [growing.Model(0, growing.boosted(), 0, 0)], keep=True)


def test_a_move_costs_one_set(spark, rows, monkeypatch):
    """A swapped feature meets the trees' other features once a row, not once a swap."""
    model = ESTIMATORS["forest"]().fit(rows)
    trees, asked = importance.stored_trees(spark, model), []
    coded = importance.Coded(trees)

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            asked.append(len(out))
            return out

    coded.trees = [(t, [(i, table.view(Counted)) for i, table in tables]) for t, tables in coded.trees]
    x = np.array([r.x for r in rows.select(vector_to_array("features").alias("x")).collect()])
    codes = coded.of(x)
    distinct = len(coded.numbers(codes)[0])
    _, changed = importance.predictions(coded, codes, codes[::-1])
    swaps = sum(len(np.unique(np.column_stack([codes, codes[::-1, at]]), axis=0)) for at in range(len(coded.slots)))
    assert len(changed) == len(coded.slots) and sum(asked) <= sum(len(tables) for _, tables in coded.trees) * distinct + len(trees) * swaps


def test_the_query_fits_no_forest_of_spark(spark, sf_dir, monkeypatch):
    """A level of Spark's forest costs as much as all rows times all trees; over 900,000 rows the query's five did not end in 300 s."""
    from armwave.plans.catalogue import QUERIES

    def refuse(*_):
        raise AssertionError("fitted by Spark")

    monkeypatch.setattr(RandomForestRegressor, "_fit", refuse)
    assert len(QUERIES["permutation_importance"].run(spark, sf_dir).collect()) >= 3
