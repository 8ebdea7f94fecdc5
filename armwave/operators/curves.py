"""Smoothed and fitted curves. Rows are collapsed to (group, day) sums before any local work."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.operators.ordering import exact_percentiles
from armwave.operators.waves import daily, point_avg_balanced, rolling_mean
from armwave.session import cut_lineage


def _schema_of(df: DataFrame, cols: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


DAYS_OF_A_BLOCK = 128


def lowess(df: DataFrame, y: str, frac: float = 0.1, by: Sequence[str] = (), day: str = "day", robust: int = 3) -> DataFrame:
    """Locally weighted regression of y on day per group, with ``robust`` reweighting rounds.

    A fit needs only row counts and weighted sums per (group, day): a table as long as the days are
    many. Reweighting goes back to the rows: residuals, their exact median per group, new weights,
    new sums. So the rows are never gathered, and the curve equals the one fitted on single rows. A group is fitted in
    blocks of days, each with the table of all its days.
    """
    by = list(by)
    one = [] if by else ["_all"]
    keys = by or one
    base = df if by else df.withColumn("_all", F.lit(0))
    base = base.where(F.col(y).isNotNull() & F.col(day).isNotNull())
    base = base.select(*keys, F.col(day).alias("day"), F.col(y).cast("double").alias("y"))
    schema = _schema_of(base, keys) + ", day double, smoothed double"

    def local_fit(pdf):
        """Fits at the days of one block; the table holds all days of the group."""
        pdf = pdf.sort_values("day")
        x, n, w, wy = (pdf[c].to_numpy(dtype="float64") for c in ("day", "n", "w", "wy"))
        k = max(int(frac * n.sum() + 1e-10), 1)
        at = x[np.floor(x / DAYS_OF_A_BLOCK) == pdf["block"].iloc[0]]
        gap = np.abs(x[None, :] - at[:, None])
        order = np.argsort(gap, axis=1, kind="stable")
        reach = np.minimum((np.cumsum(n[order], axis=1) < k).sum(axis=1), len(x) - 1)
        h = np.take_along_axis(gap, order[np.arange(len(at)), reach][:, None], axis=1)
        u = np.where(h > 0, gap / np.where(h > 0, h, 1.0), np.where(gap == 0, 0.0, 2.0))
        kernel = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - np.clip(u, 0, 1) ** 3) ** 3, 0.0))
        a, b = kernel * w, kernel * wy
        total = a.sum(axis=1)
        safe = np.where(total > 0, total, 1.0)
        centre = (a @ x) / safe
        off = x[None, :] - centre[:, None]
        spread = (a * off ** 2).sum(axis=1) / safe
        level = b.sum(axis=1) / safe
        # a spread this small against the range of x carries no slope
        steep = spread > (0.001 * (x[-1] - x[0])) ** 2
        level = level + np.where(steep, (at - centre) * (b * off).sum(axis=1) / safe / np.where(steep, spread, 1.0), 0.0)
        out = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame({**out, "day": at, "smoothed": np.where(total > 0, level, np.nan)})[[*keys, "day", "smoothed"]]

    def fit(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*keys, "day").agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
        blocks = sums.select(*keys, F.floor(F.col("day") / DAYS_OF_A_BLOCK).alias("block")).distinct()
        return sums.join(blocks, keys).groupBy(*keys, "block").applyInPandas(local_fit, schema)

    base = cut_lineage(base)
    curve = fit(base.withColumn("w", F.lit(1.0)))
    for _ in range(robust):
        curve = cut_lineage(curve)
        size = base.join(curve, [*keys, "day"]).withColumn("_r", F.abs(F.col("y") - F.col("smoothed")))
        spread = exact_percentiles(size, "_r", (0.5,), keys, ("_m",))
        u = F.try_divide(F.col("_r"), F.lit(6.0) * F.col("_m"))
        weight = F.when(u.isNull() | (u < 0.001), 1.0).when(u > 0.999, 0.0).otherwise(F.pow(1 - u * u, F.lit(2.0)))
        curve = fit(size.join(spread, keys).withColumn("w", weight))
    return curve.drop(*one)


def poly2(points: DataFrame, by: Sequence[str], x: str = "day", y: str = "mean_y", grid: int = 100) -> DataFrame:
    """Least-squares quadratic through each group's points, on an even grid between first and last.

    x is centred and scaled per group, then the 3 x 3 normal equations are solved in closed form.
    """
    by = list(by)
    kept = points.where(F.col(y).isNotNull())
    centre = kept.groupBy(*by).agg(F.avg(x).alias("_c"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"))
    u = (F.col(x) - F.col("_c")) / (F.col("_hi") - F.col("_lo"))
    m = kept.join(centre.where((F.col("_n") > 2) & (F.col("_hi") > F.col("_lo"))), by).groupBy(*by, "_c", "_lo", "_hi").agg(
        F.count(x).cast("double").alias("s0"), *[F.sum(F.pow(u, F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        *[F.sum(F.pow(u, F.lit(float(k))) * F.col(y)).alias(f"t{k}") for k in (0, 1, 2)])

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    d = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    coefs = m.withColumns({
        "_a0": F.try_divide(det(t0, s1, s2, t1, s2, s3, t2, s3, s4), d),
        "_a1": F.try_divide(det(s0, t0, s2, s1, t1, s3, s2, t2, s4), d),
        "_a2": F.try_divide(det(s0, s1, t0, s1, s2, t1, s2, s3, t2), d),
    })
    step = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / F.lit(float(grid - 1))
    v = (F.col("x") - F.col("_c")) / (F.col("_hi") - F.col("_lo"))
    return (
        coefs.withColumn("step", step).withColumn("x", at)
        .select(*by, "step", "x", (F.col("_a0") + F.col("_a1") * v + F.col("_a2") * v * v).alias("smoothed"))
    )


def exp_fit(points: DataFrame, by: Sequence[str], x: str = "day", y: str = "mean_y", offset: bool = True,
            start: Sequence[float] | None = None, rounds: int = 2000) -> DataFrame:
    """``a exp(-b x) + c`` (or without c) through at least four points per group; nulls if it fails.

    Each group holds one point per timepoint, so a damped least-squares fit per group is small work.
    """
    by = list(by)
    first = list(start or ((1.0, 0.1, 1.0) if offset else (1.0, 0.001)))
    schema = _schema_of(points, by) + ", a double, b double, c double, sse double"

    def fit(pdf):
        pdf = pdf.dropna(subset=[y])
        found = [None, None, None, None]
        if len(pdf) >= 4:
            t, v = pdf[x].to_numpy(dtype="float64"), pdf[y].to_numpy(dtype="float64")

            def model(q):
                e = np.exp(np.clip(-q[1] * t, -700, 700))
                r = q[0] * e + (q[2] if offset else 0.0) - v
                jac = np.column_stack([e, -q[0] * t * e] + ([np.ones_like(t)] if offset else []))
                return r, jac

            q, damp = np.array(first), 1e-3
            r, jac = model(q)
            converged = False
            for _ in range(rounds):
                normal = jac.T @ jac
                try:
                    step = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), -jac.T @ r)
                except np.linalg.LinAlgError:
                    break
                r2, jac2 = model(q + step)
                if np.isfinite(r2).all() and r2 @ r2 <= r @ r:
                    small = np.abs(step).max() <= 1e-10 * (np.abs(q).max() + 1e-10) or r @ r - r2 @ r2 <= 1e-14 * (r @ r)
                    q, r, jac, damp = q + step, r2, jac2, max(damp / 5, 1e-14)
                    if small:
                        converged = True
                        break
                else:
                    damp *= 4
                    if damp > 1e14:
                        converged = True
                        break
            if converged:
                found = [q[0], q[1], q[2] if offset else None, float(r @ r)]
        return pd.DataFrame([[*[pdf[k].iloc[0] if len(pdf) else None for k in by], *found]], columns=[*by, "a", "b", "c", "sse"])

    return points.where(F.col(y).isNotNull()).groupBy(*by).applyInPandas(fit, schema)


def exp_curve(points: DataFrame, by: Sequence[str], x: str = "day", y: str = "mean_y", grid: int = 100, **how) -> DataFrame:
    """The fitted exponential of each group at ``grid`` places between its first and last point; nothing where the fit fails."""
    by = list(by)
    x = x if x in points.columns else "x"
    fitted = exp_fit(points, by, x, y, **how).where(F.col("a").isNotNull())
    ends = points.where(F.col(y).isNotNull()).groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    step = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / F.lit(float(grid - 1))
    value = F.col("a") * F.exp(-F.col("b") * F.col("x")) + F.coalesce("c", F.lit(0.0))
    return fitted.join(ends, by).withColumn("step", step).withColumn("x", at).select(*by, "x", value.alias("smoothed"))


def curve_counts(df: DataFrame, y: str, timepoints: Sequence[int], delta: int, by: Sequence[str], day: str = "day") -> DataFrame:
    """Number of values behind each point of a group's curve: rows with day in [t - delta, t + delta)."""
    points = daily(df, y, by, day).withColumn("timepoint", F.explode(F.array(*[F.lit(t) for t in timepoints])))
    inside = points.where((F.col(day) >= F.col("timepoint") - delta) & (F.col(day) < F.col("timepoint") + delta))
    return inside.groupBy(*by, "timepoint").agg(F.sum("n_y").alias("n"))


def curve_table(df: DataFrame, y: str, timepoints: Sequence[int], delta: int, window: int, by: Sequence[str],
                kinds: Sequence[str] = ("poly", "mov_av", "smooth"), frac: float = 0.1) -> DataFrame:
    """All requested curves (poly, mov_av, smooth, exp) per group in long form: kind, group, x, smoothed."""
    by = list(by)
    out = None
    for kind in kinds:
        if kind == "poly":
            part = poly2(point_avg_balanced(df, y, timepoints, delta, by), by).select(*by, F.col("x"), "smoothed")
        elif kind == "mov_av":
            part = rolling_mean(df.where(F.col(y).isNotNull()), y, window, by).select(*by, F.col("day").cast("double").alias("x"), "smoothed")
        elif kind == "smooth":
            part = lowess(df, y, frac, by).select(*by, F.col("day").alias("x"), "smoothed")
        elif kind == "exp":
            part = exp_curve(point_avg_balanced(df, y, timepoints, delta, by), by)
        else:
            raise ValueError(f"unknown curve {kind!r}")
        part = part.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out
