"""Tree models on Spark ML: search, cross-validation, permutation tests, importances, run tables."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armwave.functions.numbers import truncate
from armwave.operators import permuted
from armwave.operators.assoc import wilcoxon, wilcoxon_p
from armwave.operators.describe import bounds
from armwave.operators.features import group_folds, slot_names
from armwave.operators.ordering import exact_percentiles, row_index
from armwave.session import cut_lineage

# Parameter grids of the batch run.
FOREST_GRID = {"n_estimators": [100, 300], "max_depth": [10, None], "min_samples_split": [2, 10], "min_samples_leaf": [1, 4]}
BOOSTED_GRID = {"n_estimators": [100, 300], "max_depth": [10], "colsample_bytree": [0.5, 0.3], "min_child_weight": [2, 10, 1, 4]}


# ---- estimators and search ----------------------------------------------------------------------

def rf(params: Mapping | None = None, features: str = "features", label: str = "label", seed: int = 42) -> RandomForestRegressor:
    """Random forest. No depth limit means the deepest tree Spark allows (30)."""
    p = dict(params or {})
    split = p.get("min_samples_split", 2)
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, seed=seed, numTrees=p.get("n_estimators", 100),
        maxDepth=min(p.get("max_depth") or 30, 30), minInstancesPerNode=max(p.get("min_samples_leaf", 1), split // 2),
        featureSubsetStrategy="all", bootstrap=p.get("bootstrap", True))


def gbt(params: Mapping | None = None, features: str = "features", label: str = "label", seed: int = 42) -> GBTRegressor:
    """Boosted trees; column sampling and minimum child size take Spark's nearest settings."""
    p = dict(params or {})
    return GBTRegressor(
        featuresCol=features, labelCol=label, seed=seed, maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 6),
        stepSize=p.get("learning_rate", 0.3), minInstancesPerNode=int(p.get("min_child_weight", 1)),
        featureSubsetStrategy=str(p.get("colsample_bytree", "all")), subsamplingRate=p.get("subsample", 1.0))


def param_maps(estimator: Estimator, grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of Spark parameters, as ML parameter maps."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def grid_search(df: DataFrame, estimator: Estimator, maps: Sequence[dict], label: str = "label", fold_col: str = "fold",
                k: int = 5, metric: str = "rmse", parallelism: int = 4, final: Estimator | None = None):
    """Cross-validated search over parameter maps, refitted on all rows with the best one."""
    search = CrossValidator(
        estimator=final or estimator, estimatorParamMaps=list(maps), numFolds=k, foldCol=fold_col, parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric), collectSubModels=False)
    return search.fit(df)


def random_search(df: DataFrame, estimator: Estimator, maps: Sequence[dict], n_iter: int = 10, seed: int = 42, **options):
    """As ``grid_search`` over ``n_iter`` maps drawn without replacement."""
    drawn = list(maps) if n_iter >= len(maps) else random.Random(seed).sample(list(maps), n_iter)
    return grid_search(df, estimator, drawn, **options)


def best_params(search) -> dict[str, object]:
    scores = search.avgMetrics
    pick = max if search.getEvaluator().isLargerBetter() else min
    best = search.getEstimatorParamMaps()[scores.index(pick(scores))]
    return {p.name: v for p, v in best.items()}


# ---- metrics and cross-validation ---------------------------------------------------------------

def metrics(df: DataFrame, y: str = "label", yhat: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """n, MSE, RMSE, MAE and R2 per group, in one pass."""
    error = F.col(y) - F.col(yhat)
    out = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("_v"))
    return out.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"))


def _parallel(spark: SparkSession, jobs: Sequence[Callable], threads: int) -> list:
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def settled(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, so that many fits do not repeat their preparation."""
    return cut_lineage(df)


def fold_values(df: DataFrame, fold_col: str = "fold") -> list:
    return sorted(r[0] for r in df.select(fold_col).distinct().collect())  # a handful of folds


def cross_validate(df: DataFrame, estimator: Estimator, label: str = "label", fold_col: str = "fold", threads: int = 4) -> tuple[DataFrame, dict[int, Model]]:
    """Metrics per fold (one job over all held-out rows) and the model of every fold."""
    df = settled(df)
    folds = fold_values(df, fold_col)

    def fit(f):
        return lambda: estimator.fit(df.where(F.col(fold_col) != f))

    models = dict(zip(folds, _parallel(df.sparkSession, [fit(f) for f in folds], threads)))
    held = None
    for f, model in models.items():
        part = model.transform(df.where(F.col(fold_col) == f)).select(fold_col, label, "prediction")
        held = part if held is None else held.unionByName(part)
    return metrics(held, label, "prediction", [fold_col]), models


def nested_cv(df: DataFrame, estimator: Estimator, maps: Sequence[dict], key: str, label: str = "label", fold_col: str = "fold",
              inner: int = 3, metric: str = "rmse", parallelism: int = 4) -> list[dict]:
    """Outer folds by subject; the best parameters are searched inside each training part."""
    out = []
    df = settled(df)
    for f in fold_values(df, fold_col):
        train, test = df.where(F.col(fold_col) != f).drop(fold_col), df.where(F.col(fold_col) == f)
        search = grid_search(settled(group_folds(train, key, inner, "inner")), estimator, maps, label, "inner", inner, metric, parallelism)
        scored = metrics(search.bestModel.transform(test), label).first().asDict()
        out.append({"fold": f, "params": str(best_params(search)), **scored})
    return out


# ---- permutation --------------------------------------------------------------------------------

def permute(df: DataFrame, col: str, key: str, seed: int, out: str | None = None) -> DataFrame:
    """Shuffle one column over all rows: row positions by key meet positions in a hashed order.

    The order comes from a hash of a unique key, so a recomputed task gives the same shuffle.
    """
    out = out or col
    rows = row_index(df, key, key, "_at")
    mixed = df.select(F.col(key).alias("_k"), F.col(col).alias("_value")).withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_k").cast("string")).cast("binary")))
    values = row_index(mixed, "_h", "_k", "_at").select("_at", "_value")
    return rows.drop(*([out] if out in df.columns else [])).join(values, "_at").drop("_at").withColumnRenamed("_value", out)


def permutation_scores(df: DataFrame, estimator: Estimator, key: str, label: str = "label", fold_col: str = "fold",
                       n_permutations: int = 100, seed: int = 42, threads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(actual, permuted) R2 rows: in each fold, y is shuffled in the training part and refitted.

    Ridge regressions are fitted from cross products, many permutations a job; other estimators one fit at a time.
    """
    df = settled(df)
    actual, _ = cross_validate(df, estimator, label, fold_col, threads)
    if permuted.fits_by_sums(estimator):
        return actual.select(fold_col, "r2"), permuted.ridge_scores(df, estimator, key, label, fold_col, n_permutations, seed)
    tasks = [(f, i) for f in fold_values(df, fold_col) for i in range(n_permutations)]

    def run(f, i):
        def job():
            train = permute(df.where(F.col(fold_col) != f), label, key, seed * 100_003 + i * 101 + int(f))
            test = df.where(F.col(fold_col) == f)
            row = metrics(estimator.fit(settled(train)).transform(test), label).first()
            return int(f), i, row["r2"]

        return job

    rows = _parallel(df.sparkSession, [run(f, i) for f, i in tasks], threads)
    return actual.select(fold_col, "r2"), df.sparkSession.createDataFrame(rows, f"{fold_col} int, permutation int, r2 double")


def permutation_stats(actual: DataFrame, permuted: DataFrame, score: str = "r2", corrected: bool = False) -> DataFrame:
    """Mean score, p, z, percentile and the 95% band of the permuted scores.

    ``corrected`` counts the actual score as one of the permutations: (hits + 1) / (n + 1).
    """
    mean = actual.agg(F.avg(score).alias("mean_score")).withColumn("_k", F.lit(0))
    rows = permuted.select(F.col(score).alias("_s"), F.lit(0).alias("_k")).join(F.broadcast(mean), "_k")
    hits, n = F.count_if(F.col("_s") >= F.col("mean_score")), F.count("_s")
    p = F.try_divide(hits + 1, n + 1) if corrected else F.try_divide(hits, n)
    stats = rows.groupBy("_k", "mean_score").agg(
        n.alias("n"), p.alias("p_value"), F.avg("_s").alias("perm_mean"), F.stddev_samp("_s").alias("perm_sd"),
        (F.lit(100.0) * F.count_if(F.col("_s") < F.col("mean_score")) / n).alias("percentile"))
    band = exact_percentiles(rows, "_s", (0.025, 0.975), ["_k"], ("ci_low", "ci_high"))
    z = F.try_divide(F.col("mean_score") - F.col("perm_mean"), F.col("perm_sd"))
    return stats.join(band, "_k").select("n", "mean_score", "p_value", "perm_mean", "perm_sd", z.alias("z_score"), "percentile", "ci_low", "ci_high")


def perm_importance(df: DataFrame, model: Model, n_features: int, key: str, label: str = "label", features: str = "features",
                    repeats: int = 10, seed: int = 42) -> DataFrame:
    """R2 drop per feature when it is shuffled over the given rows: mean and SD over repeats.

    For every repeat each row meets one partner row (a shuffled position); the swapped vectors of
    all features are built and scored in the same stage and only sums are shuffled.
    """
    base = df.select(F.col(key).alias("_k"), F.col(label).alias("_y"), vector_to_array(features).alias("_x"))
    rows = base.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    at = row_index(rows, "_k", "_k", "_at", ["repeat"])
    mixed = rows.select("repeat", "_k", F.col("_x").alias("_p")).withColumn(
        "_h", F.pmod(F.xxhash64(F.lit(seed), F.col("repeat"), F.col("_k")), F.lit(1 << 50)))
    partner = row_index(mixed, "_h", "_k", "_at", ["repeat"]).select("repeat", "_at", "_p")
    swapped = at.join(partner, ["repeat", "_at"]).withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1)))).select(
        "repeat", "feature", F.col("_y").alias(label),
        array_to_vector(F.transform("_x", lambda v, i: F.when(i == F.col("feature"), F.get("_p", i)).otherwise(v))).alias(features))
    shuffled = metrics(model.transform(swapped), label, "prediction", ["feature", "repeat"])
    reference = metrics(model.transform(df), label).first()["r2"]
    return shuffled.groupBy("feature").agg(
        (F.lit(reference) - F.avg("r2")).alias("importance"), F.stddev_pop("r2").alias("sd"))


def mean_importance(tables: Sequence[DataFrame]) -> DataFrame:
    """Importance averaged over folds."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("feature").agg(F.avg("importance").alias("importance"))


def importances(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Named feature importances of a fitted tree model, largest first; every feature is listed."""
    values = model.featureImportances.toArray().tolist()
    names = slot_names(df, features) or [f"slot_{i}" for i in range(len(values))]
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))]
    return df.sparkSession.createDataFrame(rows, "slot int, feature string, importance double").orderBy(F.col("importance").desc(), "slot")


def ranked_slots(model) -> list[int]:
    values = model.featureImportances.toArray()
    return sorted(range(len(values)), key=lambda i: (-values[i], i))


def with_slots(df: DataFrame, slots: Sequence[int], features: str = "features") -> DataFrame:
    """Replace the vector by the chosen slots."""
    cut = VectorSlicer(inputCol=features, outputCol="_cut", indices=sorted(slots)).transform(df)
    return cut.drop(features).withColumnRenamed("_cut", features)


def refit_topk(df: DataFrame, estimator: Estimator, model, k: int, **options) -> tuple[DataFrame, dict[int, Model]]:
    """Cross-validate again on the k most important slots."""
    return cross_validate(with_slots(df, ranked_slots(model)[:k], estimator.getFeaturesCol()), estimator, **options)


def refit_without_top(df: DataFrame, estimator: Estimator, model, n: int, fold_col: str = "fold", **options) -> dict:
    """Cross-validate with and without the n most important slots and compare R2 by fold (signed ranks)."""
    full, _ = cross_validate(df, estimator, fold_col=fold_col, **options)
    cut, _ = cross_validate(with_slots(df, ranked_slots(model)[n:], estimator.getFeaturesCol()), estimator, fold_col=fold_col, **options)
    both = full.select(fold_col, F.col("r2").alias("full_r2")).join(cut.select(fold_col, F.col("r2").alias("cut_r2")), fold_col)
    test = wilcoxon(both, "cut_r2", "full_r2").first()
    return {"folds": both, "w": test["w"], "n": test["n"], "p": wilcoxon_p(test["n"] or 0, test["w"] or 0.0, test["tie_sum"] or 0.0) if test["n"] else None}


# ---- run tables ---------------------------------------------------------------------------------

RUN_SCHEMA = ("model string, cross_validation string, params string, mse double, rmse double, mae double, r2 double, "
              "outcome string, input string, feature_selection string, threshold int")


def params_text(params: Mapping) -> str:
    return "\n".join(f"{k}: {v}" for k, v in params.items())


def result_row(fold_metrics: DataFrame, info: Mapping[str, object], params: Mapping) -> DataFrame:
    """Run table row: fold means cut to four decimals, with the settings as text."""
    means = fold_metrics.agg(*[truncate(F.avg(c), 4).alias(c) for c in ("mse", "rmse", "mae", "r2")])
    return means.select(
        F.lit(info["model"]).alias("model"), F.lit(info["cv"]).alias("cross_validation"), F.lit(params_text(params)).alias("params"),
        "mse", "rmse", "mae", "r2", F.lit(info["outcome"]).alias("outcome"), F.lit(info["input"]).alias("input"),
        F.lit(info["selection"]).alias("feature_selection"), F.lit(int(info["threshold"])).alias("threshold"))


def day_clusters(df: DataFrame, k: int = 4, day: str = "day", seed: int = 42) -> tuple[DataFrame, list[float]]:
    """k-means on days: low and high day of every cluster (clusters in day order) and the sorted centres."""
    rows = VectorAssembler(inputCols=[day], outputCol="_v").transform(df.where(F.col(day).isNotNull()).select(F.col(day).cast("double").alias(day)))
    model = KMeans(featuresCol="_v", predictionCol="_c", k=k, seed=seed).fit(rows)
    centres = [float(c[0]) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=centres.__getitem__)
    place: Column = F.array(*[F.lit(order.index(i)) for i in range(len(centres))])
    labelled = model.transform(rows).withColumn("cluster", F.get(place, F.col("_c")))
    return bounds(labelled, "cluster", day), sorted(centres)
