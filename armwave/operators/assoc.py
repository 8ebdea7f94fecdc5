"""Association and agreement statistics from distributed sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.functions import dist
from armwave.operators.ordering import running_sum


def corr_with(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Pearson r of one score with many columns, with the number of complete pairs."""
    both = {x: F.col(x).isNotNull() & F.col(y).isNotNull() for x in xs}
    wide = df.agg(
        *[F.corr(y, x).alias(f"r_{x}") for x in xs],
        *[F.count_if(both[x]).alias(f"n_{x}") for x in xs],
    )
    entries = [F.struct(F.lit(x).alias("variable"), F.col(f"r_{x}").alias("r"), F.col(f"n_{x}").alias("n")) for x in xs]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def with_corr_p(correlations: DataFrame) -> DataFrame:
    """Adds the two-sided p of every (r, n) row."""
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    rows = correlations.withColumns({"t": t, "free": F.col("n") - 2})
    return rows.withColumn("p", p_value_column("t", "free")).drop("t", "free")


def corr_p_value(r: float, n: int) -> float:
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else float("nan")
    return 2 * dist.t_sf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def gram(df: DataFrame, cols: Sequence[str], centre: bool = True) -> DataFrame:
    """Pairwise-complete sums (i, j, n, sx, sy, sxx, syy, sxy) for every i <= j.

    Arrow batches are turned into block products, one partial table per task; the tables are then
    added up. With ``centre`` the column means are subtracted first, for stable correlations.
    """
    cols = list(cols)
    p = len(cols)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    shift = [0.0] * p
    if centre:
        means = values.agg(*[F.avg(c).alias(c) for c in cols]).first()
        shift = [means[c] or 0.0 for c in cols]

    def block_sums(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - np.asarray(shift)
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m, sq = seen.astype("float64"), x * x
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(p)
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": total[0][i, j].round().astype("int64"),
                                **{k: total[d][i, j] for d, k in enumerate(("sx", "sy", "sxx", "syy", "sxy"), 1)}})

    schema = "i int, j int, n bigint, sx double, sy double, sxx double, syy double, sxy double"
    parts = values.mapInPandas(block_sums, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def _named(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.withColumns({"left": F.get(names, F.col("i")), "right": F.get(names, F.col("j"))})


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix in long form; a constant column gives null."""
    g = gram(df, cols).where(F.col("i") < F.col("j"))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return _named(g, cols).select("i", "j", "left", "right", "n", r.alias("weight"))


def cosine_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cosine of every two columns after mean imputation, from the same pairwise sums.

    sum(x' y') over imputed data = sxy + (sum of x where y is absent) * mean y + (the reverse)
    + (rows where both are absent) * mean x * mean y.
    """
    g = gram(df, cols, centre=False)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    own = g.where(F.col("i") == F.col("j")).select(
        F.col("i").alias("k"), F.col("n").alias("kn"), F.col("sx").alias("ks"), F.col("sxx").alias("kss"))
    x, y = own.select(*[F.col(c).alias(f"x{c}") for c in own.columns]), own.select(*[F.col(c).alias(f"y{c}") for c in own.columns])
    pairs = (
        g.where(F.col("i") < F.col("j")).join(x, F.col("i") == F.col("xk")).join(y, F.col("j") == F.col("yk"))
        .withColumn("_k", F.lit(0)).join(rows.withColumn("_k", F.lit(0)), "_k")
    )
    mx, my = F.try_divide(F.col("xks"), F.col("xkn")), F.try_divide(F.col("yks"), F.col("ykn"))
    neither = F.col("rows") - F.col("xkn") - F.col("ykn") + F.col("n")
    dot = F.col("sxy") + (F.col("xks") - F.col("sx")) * my + (F.col("yks") - F.col("sy")) * mx + neither * mx * my
    norm_x = F.col("xkss") + (F.col("rows") - F.col("xkn")) * mx * mx
    norm_y = F.col("ykss") + (F.col("rows") - F.col("ykn")) * my * my
    return _named(pairs, cols).select("i", "j", "left", "right", F.try_divide(dot, F.sqrt(norm_x * norm_y)).alias("weight"))


def similarity_graph(matrix: DataFrame, threshold: float, signed: bool = False) -> DataFrame:
    """Edges (left, right, weight, colour) above the threshold; ``signed`` keeps only |w| by sign colour."""
    w = F.col("weight")
    if signed:
        edges = matrix.where((w > threshold) | (w < -threshold))
        colour = F.when(w > 0, "blue").otherwise("red")
    else:
        edges, colour = matrix.where(F.abs(w) > threshold), F.lit("blue")
    return edges.select("left", "right", "weight", colour.alias("colour"))


def graph_nodes(matrix: DataFrame, edges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every column with its degree; isolated columns have degree 0."""
    names = matrix.sparkSession.createDataFrame([(c,) for c in cols], "node string")
    ends = edges.select(F.col("left").alias("node")).unionByName(edges.select(F.col("right").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return names.join(degree, "node", "left").fillna(0, ["degree"])


def rater_item_corr(df: DataFrame, a: str = "_p", b: str = "_t") -> DataFrame:
    """r of each item rated by two raters, matched by column suffix."""
    items = [c[: -len(a)] for c in df.columns if c.endswith(a) and c[: -len(a)] + b in df.columns]
    wide = df.agg(*[F.corr(i + a, i + b).alias(i) for i in items])
    return wide.unpivot([], items, "item", "r")


def paired_item_corr(pairs: DataFrame, items: Sequence[str]) -> DataFrame:
    """r and mean difference of items in ``<item>_a`` / ``<item>_b`` columns."""
    wide = pairs.agg(*[F.struct(F.corr(f"{i}_a", f"{i}_b").alias("r"), (F.avg(f"{i}_a") - F.avg(f"{i}_b")).alias("mean_diff"))
                       .alias(i) for i in items])
    entries = [F.struct(F.lit(i).alias("item"), F.col(f"{i}.r"), F.col(f"{i}.mean_diff")) for i in items]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def icc_mean_squares(df: DataFrame, target: str, rater: str, value: str, raters: Sequence) -> DataFrame:
    """Two-way mean squares over targets that every rater rated: n, k, ms_target, ms_error, icc3.

    The raters are known and few; a target is one row of k sums after the first aggregation.
    Repeated ratings of a target by one rater are averaged.
    """
    k = len(raters)
    wide = df.groupBy(target).agg(*[F.avg(F.when(F.col(rater) == F.lit(r), F.col(value))).alias(f"x{i}") for i, r in enumerate(raters)])
    wide = wide.dropna(subset=[f"x{i}" for i in range(k)])
    total = sum((F.col(f"x{i}") for i in range(k)), F.lit(0.0))
    within = sum((F.pow(F.col(f"x{i}") - total / k, 2) for i in range(k)), F.lit(0.0))
    sums = wide.agg(
        F.count(F.lit(1)).alias("n"), (F.var_pop(total / k) * F.count(F.lit(1)) * k).alias("ss_target"),
        F.sum(within).alias("ss_within"), F.avg(total / k).alias("grand"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)],
    )
    ss_rater = sum((F.pow(F.col(f"m{i}") - F.col("grand"), 2) for i in range(k)), F.lit(0.0)) * F.col("n")
    ms_target = F.try_divide(F.col("ss_target"), F.col("n") - 1)
    ms_error = F.try_divide(F.col("ss_within") - ss_rater, (F.col("n") - 1) * (k - 1))
    icc3 = F.try_divide(ms_target - ms_error, ms_target + F.lit(k - 1) * ms_error)
    return sums.select("n", F.lit(k).alias("k"), ms_target.alias("ms_target"), ms_error.alias("ms_error"), icc3.alias("icc3"))


def icc(df: DataFrame, target: str, rater: str, value: str, raters: Sequence, level: float = 0.95) -> dict:
    """ICC3 with F test and confidence interval."""
    row = icc_mean_squares(df, target, rater, value, raters).first()
    n, k = row["n"], row["k"]
    d1, d2 = n - 1, (n - 1) * (k - 1)
    f = row["ms_target"] / row["ms_error"]
    tail = (1 - level) / 2
    low, high = f / dist.f_ppf(1 - tail, d1, d2), f * dist.f_ppf(1 - tail, d2, d1)
    return {"icc": row["icc3"], "f": f, "df1": d1, "df2": d2, "p": dist.f_sf(f, d1, d2),
            "ci_low": (low - 1) / (low + k - 1), "ci_high": (high - 1) / (high + k - 1)}


def linreg(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, r, slope SE and n per group."""
    out = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"),
        F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
    )
    se = F.sqrt(F.try_divide((F.lit(1.0) - F.col("r") * F.col("r")) * F.col("_syy"), F.col("_sxx") * (F.col("n") - 2)))
    return out.withColumn("slope_se", F.when(F.col("n") > 2, se)).drop("_sxx", "_syy")


def t_test_summary(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Two-sample t with pooled variance from means, SDs and counts: (t, degrees of freedom)."""
    free = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, free)
    t = F.try_divide(m1 - m2, F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    return t, free


def p_value_column(t: str, free: str) -> Column:
    """Two-sided p of a t statistic for small result tables, in Arrow batches."""
    sf = dist.t_sf

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else 2 * sf(abs(a), b) for a, b in zip(t, free)], dtype="float64")

    return two_sided(F.col(t), F.col(free).cast("double"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of a - b: zeros dropped, ties averaged. One row (n, w_plus, w_minus, w, tie_sum).

    Differences are counted per absolute value first, so ranking runs over distinct values.
    """
    d = F.col(a) - F.col(b)
    sizes = (
        df.select(d.alias("d")).where(F.col("d").isNotNull() & (F.col("d") != 0))
        .groupBy(F.abs("d").alias("size"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_plus"))
    )
    ranked = running_sum(sizes, "size", "size", "_start", (), F.col("n"))
    rank = F.col("_start") + (F.col("n") + 1) / F.lit(2.0)
    ties = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("n").alias("n"), F.sum(rank * F.col("n_plus")).alias("w_plus"),
        F.sum(rank * (F.col("n") - F.col("n_plus"))).alias("w_minus"), F.sum(ties * ties * ties - ties).alias("tie_sum"),
    )
    return sums.select("n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), "tie_sum")


def wilcoxon_p(n: int, w: float, tie_sum: float = 0.0) -> float:
    """Two-sided p: exact up to 50 pairs without ties, else the normal approximation."""
    if n <= 50 and tie_sum == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    se = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48)
    return 2 * dist.norm_sf(abs((w - n * (n + 1) / 4) / se))


def vif(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Variance inflation: diagonal of the inverse correlation matrix (size depends on columns only)."""
    r = np.eye(len(cols))
    for row in corr_matrix(df, cols).collect():
        r[row["i"], row["j"]] = r[row["j"], row["i"]] = row["weight"] if row["weight"] is not None else 0.0
    return dict(zip(cols, np.diag(np.linalg.inv(r)).tolist()))


def residuals(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def correlated_columns(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Columns to drop: |r| above the threshold with any earlier column, dropped or not."""
    hits = corr_matrix(df, cols).where(F.abs("weight") > threshold)
    return hits.select(F.col("right").alias("dropped")).distinct()


class CorrelationSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """ML estimator that keeps columns not too correlated with an earlier one."""

    threshold = Param(Params._dummy(), "threshold", "largest allowed |r|", TypeConverters.toFloat)
    inputCols = Param(Params._dummy(), "inputCols", "columns to look at", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, threshold=0.8):
        super().__init__()
        self._setDefault(threshold=0.8)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        cols = self.getOrDefault(self.inputCols)
        dropped = {r["dropped"] for r in correlated_columns(dataset, cols, self.getOrDefault(self.threshold)).collect()}
        return CorrelationSelectorModel(droppedCols=[c for c in cols if c in dropped])


class CorrelationSelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns found by ``CorrelationSelector``."""

    droppedCols = Param(Params._dummy(), "droppedCols", "columns removed", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, droppedCols=None):
        super().__init__()
        if droppedCols is not None:
            self._set(droppedCols=droppedCols)

    @property
    def dropped(self) -> list[str]:
        return self.getOrDefault(self.droppedCols)

    def _transform(self, dataset):
        return dataset.drop(*self.dropped)
