"""Moderators: interaction models per moderator, predictions, slopes and curves per arm and subgroup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.operators import curves, filters, mixed
from armwave.plans.replication import arm_factors


def moderator_specs(moderators: Sequence[str], outcomes: Sequence[str], raters: Sequence[str | None], sites: Sequence[int],
                    max_day: int = 450) -> list[mixed.Spec]:
    """One model per moderator, outcome and rater: day * arm * moderator, plus site.

    The rater None is for questionnaires without raters: all rows.
    """
    specs = []
    for m in moderators:
        factors = {**arm_factors(sites), m: mixed.numeric(m)}
        terms = mixed.design(factors, [*mixed.crossed(["arm", "day", m]), ("site",)])
        for y in outcomes:
            for r in raters:
                where = (F.col("day") < max_day) & F.col("arm").isin("M", "P", "C", "A")
                if r is not None:
                    where = where & (F.col("rater") == r)
                specs.append(mixed.Spec(f"{m}|{y}" + (f"|{r}" if r is not None else ""), y, terms, where))
    return specs


def moderator_tests(fit: mixed.Fit, moderator: str, alpha: float = 0.05) -> list[dict]:
    """Joint tests of arm x moderator and arm x day x moderator."""
    return mixed.wald_f(fit, {"arm_mod": ("arm", moderator), "arm_time_mod": ("arm", "day", moderator)}, alpha)


def significant_models(fits: Sequence[mixed.Fit], alpha: float = 0.05) -> list[mixed.Fit]:
    """Fits in which a joint moderator test is significant."""
    return [f for f in fits if any(t["significant"] for t in moderator_tests(f, f.model_id.split("|")[0], alpha))]


def moderator_curves(df: DataFrame, y: str, moderator: str, values: tuple[Sequence, Sequence], timepoints: Sequence[int], delta: int,
                     window: int, kinds: Sequence[str] = ("poly", "mov_av", "smooth"), arm: str = "arm",
                     days: tuple[int, int] = (-50, 450)) -> DataFrame:
    """Curves for each arm with the moderator absent and present, over the given days (``window`` only smooths)."""
    split = filters.split_moderator(df, moderator, values[0], values[1], "day", *days)
    return curves.curve_table(split, y, timepoints, delta, window, [arm, "mod_group"], kinds)


def predictions(df: DataFrame, fits: Mapping[str, tuple[mixed.Fit, mixed.Terms]]) -> DataFrame:
    """One ``predicted_<name>`` column per fit."""
    for name, (fit, terms) in fits.items():
        df = mixed.predict_fixed(df, fit, terms, f"predicted_{name}")
    return df
