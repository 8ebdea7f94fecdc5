"""Imputation, folds, permutations and tree-model helpers against direct computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from armwave.operators import features, models
from armwave.plans import experiments


def direct_knn(x, keys, k):
    out = x.copy()
    for i, q in enumerate(x):
        seen = ~np.isnan(q)
        for t in np.flatnonzero(~seen):
            best = []
            for j, d in enumerate(x):
                both = seen & ~np.isnan(d)
                if not np.isnan(d[t]) and both.any():
                    best.append((((d[both] - q[both]) ** 2).sum() * x.shape[1] / both.sum(), keys[j], d[t]))
            out[i, t] = np.mean([b[2] for b in sorted(best)[:k]]) if best else np.nanmean(x[:, t])
    return out


@pytest.mark.parametrize("max_bytes", [32 << 20, 1000])
def test_knn_impute(spark, max_bytes):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, size=(150, 4)).astype(float)  # many equal rows and ties
    x[:, 0] += rng.normal(size=150).round(1)
    x[:50] = x[0]  # a third of all rows is one pattern
    x[rng.random(x.shape) < 0.2] = np.nan
    x[7] = np.nan
    keys = rng.permutation(150)
    cols = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(key=keys)).select("key", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    got = features.knn_impute(df.repartition(5), cols, "key", 5, max_bytes).toPandas().set_index("key").loc[keys, cols].to_numpy()
    np.testing.assert_allclose(got, direct_knn(x, keys, 5), atol=1e-9)


def test_group_folds_are_disjoint_and_greedy(spark):
    sizes = [5, 4, 3, 2, 1, 1, 7, 7, 2, 30]
    rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
    got = features.group_folds(spark.createDataFrame(rows, "g long, i int"), "g", 3).toPandas()
    assert len(got) == len(rows) and got.groupby("g").fold.nunique().max() == 1
    loads = [0, 0, 0]
    for n in sorted(sizes, reverse=True):
        loads[int(np.argmin(loads))] += n
    assert sorted(got.fold.value_counts()) == sorted(loads)


def test_fair_counts_follow_the_greedy_rule():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.integers(2, 7))
        loads = [int(v) for v in rng.integers(0, 30, k)]
        size, count = int(rng.integers(1, 6)), int(rng.integers(0, 40))
        want, sim = [0] * k, list(loads)
        for _ in range(count):
            f = int(np.argmin(sim))
            sim[f] += size
            want[f] += 1
        assert features._fair_counts(loads, size, count) == want


def test_split_keeps_subjects_together(spark):
    df = spark.range(5000).select("id", (F.col("id") % 400).alias("s"))
    got = features.group_split(df, "s", 0.25, 1)
    assert got.groupBy("s").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    assert 0.15 < got.where("is_test").count() / 5000 < 0.35
    assert got.where("is_test").count() == features.group_split(df.repartition(3), "s", 0.25, 1).where("is_test").count()


def test_permute_is_a_permutation(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("y"), F.col("id").cast("double").alias("z"))
    once, again = (features_frame(models.permute(df.repartition(n), "z", "id", 5)) for n in (3, 6))
    assert sorted(once.z) == list(range(2000)) and (once.z == again.z).all()
    assert (once.z != once.index).mean() > 0.95 and abs(np.corrcoef(once.z, once.index)[0, 1]) < 0.1


def features_frame(df):
    return df.toPandas().set_index("id").sort_index()


@pytest.fixture(scope="module")
def linear(spark):
    """Label depends on slot 0 strongly, on slot 1 weakly, not on slot 2."""
    df = spark.range(600).select(
        "id", (F.col("id") % 60).alias("s"), *[(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)) / 1000).alias(f"x{i}") for i in range(3)])
    df = df.withColumn("label", 5 * F.col("x0") + F.col("x1")).withColumn("features", array_to_vector(F.array("x0", "x1", "x2")))
    return models.settled(features.group_folds(df, "s", 3))


def test_permutation_importance_orders_features(linear):
    model = LinearRegression().fit(linear)
    got = {r["feature"]: r["importance"] for r in models.perm_importance(linear, model, 3, "id", repeats=3).collect()}
    assert got[0] > 1.5 and 0.01 < got[1] < got[0] and abs(got[2]) < 1e-6


def test_permutation_test_separates_signal(linear):
    actual, permuted = models.permutation_scores(linear, LinearRegression(), "id", n_permutations=2)
    stats = models.permutation_stats(actual, permuted).first()
    assert stats["n"] == 6 and stats["mean_score"] > 0.99 and stats["p_value"] == 0 and stats["perm_mean"] < 0.2
    assert models.permutation_stats(actual, permuted, corrected=True).first()["p_value"] == pytest.approx(1 / 7)


def test_selection_and_refits(linear):
    est = models.rf({"n_estimators": 5, "max_depth": 4})
    model = est.fit(linear)
    assert models.ranked_slots(model)[0] == 0
    top, _ = models.refit_topk(linear, est, model, 1)
    cut = models.refit_without_top(linear, est, model, 1)
    assert top.agg(F.avg("r2")).first()[0] > 0.8 and cut["n"] == 3 and cut["w"] == 0 and cut["p"] == 0.25
    assert cut["folds"].agg(F.avg("cut_r2")).first()[0] < 0.3


def test_search_picks_the_better_depth(linear):
    est = models.rf({"n_estimators": 5})
    search = models.grid_search(linear, est, models.param_maps(est, {"maxDepth": [1, 5]}), k=3)
    assert models.best_params(search) == {"maxDepth": 5}


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.normal(size=50), rng.normal(size=50)
    got = models.metrics(spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))).first()
    assert abs(got["r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12 and abs(got["mae"] - np.abs(y - p).mean()) < 1e-12


def test_pipeline_stages(spark):
    df = spark.createDataFrame([(1.0, None, "a", 1.0, 2.0), (3.0, 2.0, None, None, None), (5.0, 4.0, "b", 2.0, 4.0), (None, 6.0, "a", 1.0, 6.0)],
                               "n double, m double, s string, k double, o double")
    kinds = features.feature_types(df, [("n", "num"), ("m", "num"), ("k", "cat"), ("o", "ord"), ("s", "cat")], ())
    assert kinds == {"ord": ["o"], "num": ["n", "m"], "cat_str": ["s"], "cat_num": ["k"]}
    filled = features.fill_categories(df, kinds["cat_str"], kinds["cat_num"])
    model = features.feature_pipeline(kinds).fit(filled)
    x = np.array([r[0] for r in model.transform(filled).select(vector_to_array("features")).collect()])
    n = np.array([1, 3, 5, 3.0])
    np.testing.assert_allclose(x[:, 0], (n - 3) / n.std())
    names = features.slot_names(model.transform(filled))
    assert len(names) == x.shape[1] and any("missing" in v for v in names)
    unseen = model.transform(filled.limit(1).withColumn("s", F.lit("new"))).select(vector_to_array("features")).first()[0]
    start = [i for i, v in enumerate(names) if v.startswith("cat_str__s")]
    assert all(unseen[i] == 0 for i in start)


def test_prepare_data_reports_absent_and_pruned(spark):
    pred = spark.createDataFrame([(1, "M", 1.0, 2.0), (2, "P", 3.0, 1.0)], "subject long, arm string, q_a_m double, q_b_t double")
    out = spark.createDataFrame([(1, 5.0, None), (2, 6.0, None), (3, None, None)], "subject long, y_m double, z_m double")
    data, y = features.prepare_data(pred, out, "y", "m", "m")
    assert y == "y_m_out" and data.count() == 2 and "q_b_t" not in data.columns
    assert features.prepare_data(pred, out, "absent", "m") is None and features.prepare_data(pred, out, "z", "m") is None


def test_grid_skips_finished_runs():
    config = {"outcome": ["a", "b"], "model": ["forest"]}
    assert len(experiments.combinations(config)) == 2
    assert experiments.pending(config, [{"outcome": "a", "model": "forest"}]) == [{"outcome": "b", "model": "forest"}]


def test_text_keys(spark):
    from armwave.operators import audit, features, models, vectors

    rows = [(f"S{i:02d}", float(i % 5), float(i % 3) if i % 4 else None, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, a double, b double, y int")
    assert features.group_folds(df, "key", 4).groupBy("fold").count().count() == 4
    filled = features.knn_impute(df, ["a", "b"], "key")
    assert filled.where("b is null").count() == 0 and filled.count() == 40
    vecs = spark.createDataFrame([("S1", [0.0, 0.0]), ("S2", [0.1, 0.0]), ("S3", [9.0, 9.0])], "key string, v array<double>")
    found = vectors.density_clusters(vecs, "key", "v", 0.5)
    assert {r["key"]: r["cluster"] for r in found.collect()} == {"S1": "S1", "S2": "S1", "S3": None}
    assert vectors.cluster_members(found).count() == 2 and vectors.outliers(found).count() == 1
    dotted = df.withColumnRenamed("a", "a.b")
    assert audit.profile(dotted).count() == 4 and audit.profile(dotted, approx=True).count() == 4
    assert {r["column"] for r in audit.verify_audit(dotted, [4]).collect()} == {"a.b"} | set()


def test_nearest_donors_are_looked_up(monkeypatch):
    """Sorted donors give the neighbours of a full comparison, ties by rank, missing and infinite values included, and few donors are read."""
    import numpy as np

    rng = np.random.default_rng(6)
    d = np.column_stack([rng.normal(size=6000) * 40, rng.integers(0, 7, 6000), rng.integers(0, 3, 6000) / 2]).astype(float)
    d[rng.random(d.shape) < 0.1] = np.nan
    d[:3, 0] = np.inf
    rank = rng.permutation(6000)
    donors = features._Donors(d, rank)
    have, p, k = ~np.isnan(d), 3, 5
    asked = [np.array(q, float) for q in ([np.nan, 3, 1], [12.5, np.nan, 0.5], [7.25, 2, np.nan], [np.nan, np.nan, 0], [-500, np.nan, np.nan], [np.inf, np.nan, 1])]
    for q in asked:
        seen = ~np.isnan(q)
        both = have[:, seen]
        shared = both.sum(axis=1)
        with np.errstate(invalid="ignore"):
            gap = np.where(both, np.where(have, d, 0.0)[:, seen] - q[seen], 0.0)
            dist = np.where(shared > 0, (gap * gap).sum(axis=1) * p / np.maximum(shared, 1), np.inf)
        for target in np.flatnonzero(~seen):
            usable = np.flatnonzero(have[:, target] & np.isfinite(dist))
            best = usable[np.lexsort((rank[usable], dist[usable]))][:k]
            row, far = donors.best(q, seen, target, k)
            assert row.tolist() == best.tolist() and far.tolist() == dist[best].tolist()
    read = []
    isfinite = np.isfinite
    monkeypatch.setattr(np, "isfinite", lambda x: read.append(np.size(x)) or isfinite(x))
    donors.best(asked[1], ~np.isnan(asked[1]), 1, k)
    assert 0 < sum(read) < 3000
