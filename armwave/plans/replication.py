"""Replication: questionnaire rows to descriptive tables, random-intercept models and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.operators import describe, mixed, waves


def outcome_table(visits: DataFrame, ys: Sequence[str] = ("score",), cuts: Mapping[str, int] = waves.CUTS) -> DataFrame:
    """Mean, SD and N of every outcome by arm, cumulative window and rater."""
    return describe.summary(waves.split_waves(visits, cuts), ["arm", "wave", "rater"], list(ys))


def arm_factors(sites: Sequence[int], ref: str = "A", arms: Sequence[str] = ("M", "P", "C", "A")) -> dict:
    """Design factors of the trial models: arm against a reference arm, site dummies, day."""
    return {"arm": mixed.factor("arm", arms, ref), "site": mixed.factor("site", list(sites), sites[0]), "day": mixed.numeric("day")}


# Terms of the published analysis, arm by day and arm by site.
TERMS = (("arm",), ("site",), ("day",), ("arm", "day"), ("arm", "site"))


def fit_replication(visits: DataFrame, outcomes: Sequence[str], raters: Sequence[str], sites: Sequence[int] = (1, 2, 3, 4, 5, 6),
                    max_day: int = 168) -> list[mixed.Fit]:
    """One model per outcome and rater on the trial arms, all from the same aggregations."""
    terms = mixed.design(arm_factors(sites), TERMS)
    specs = [mixed.Spec(f"{y}|{r}", y, terms, (F.col("rater") == r) & (F.col("day") < max_day) & F.col("arm").isin("M", "P", "C", "A"))
             for y in outcomes for r in raters]
    return mixed.fit_many(visits, specs)


def replicated_results(published: DataFrame, fits: Sequence[mixed.Fit], rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Published table with replicated F and p; model ids are 'outcome|rater'."""
    tests = mixed.tests_table(published.sparkSession, fits)
    parts = F.split("model_id", r"\|")
    return mixed.fill_results(published, tests.withColumns({"outcome": parts[0], "rater": parts[1]}), rules)
