"""Checked queries: random-intercept models, curves, feature pipelines and tree models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import curves, ensembles, features, growing, importance, mixed, models, waves
from armwave.operators.ordering import row_index
from armwave.plans import experiments, mediators, replication
from armwave.plans.base import VISITS_SQL, table, visits
from armwave.plans.registry import query, sfix
from armwave.session import side_by_side

_V = "with " + VISITS_SQL + " "
_SITES = (1, 2, 3, 4, 5, 6)


def _trial(spark, sf_dir):
    """Visits of the trial arms with the moderator flag anx and two outcomes."""
    v = visits(spark, sf_dir)
    return v.withColumn("anx", (F.col("subject") % 2).cast("int")).withColumn("calm", F.lit(5.0) - F.col("score") + F.col("day") / 2000)


# ---- random-intercept models --------------------------------------------------------------------

@query("model_coefficients", "M1 M2 M3", None)
def model_coefficients(spark, sf_dir):
    fits = replication.fit_replication(_trial(spark, sf_dir), ["score", "calm"], ["Parent", "Teacher"], _SITES, 500)
    return mixed.coef_table(spark, fits)


@query("joint_f_tests", "M4", None)
def joint_f_tests(spark, sf_dir):
    fits = replication.fit_replication(_trial(spark, sf_dir), ["score"], ["Parent", "Teacher"], _SITES, 500)
    return mixed.tests_table(spark, fits)


@query("one_visit_model", "M2", _V + f""", f as (select arg_min(score, visit_id) filter (score is not null) as score,
  cast(arg_min(site, visit_id) filter (score is not null) as double) as site from visits group by subject)
select 'intercept' as term, {sfix('regr_intercept(score, site)')} as coef from f union all select 'site', {sfix('regr_slope(score, site)')} from f""")
def one_visit_model(spark, sf_dir):
    """With one row per subject the mixed model is ordinary least squares, which SQL can check."""
    first = waves.one_per_subject(visits(spark, sf_dir).where("score is not null").withColumn("day", F.lit(0)), "subject")
    fit = mixed.fit_random_intercept(first, "score", mixed.design({"site": mixed.numeric("site")}, [("site",)]))
    return mixed.coef_table(spark, [fit]).select("term", fixed("coef").alias("coef"))


# With one row per subject the mixed model is least squares on arm means, so SQL can check tests and contrasts too.
_FIRST_SQL = _V + """, f as (select subject, any_value(arm) as arm, arg_min(score, visit_id) filter (score is not null) as score from visits group by subject),
g as (select arm, avg(score) as m, var_samp(score) as v, count(score) as n from f where score is not null group by arm),
t as (select sum((n - 1) * v) / (sum(n) - count(*)) as s2, sum(n * m) / sum(n) as grand, count(*) as k, sum(n) as total from g)"""


def _first_scores(spark, sf_dir):
    v = visits(spark, sf_dir).where("score is not null").withColumn("day", F.lit(0))
    return waves.one_per_subject(v, "subject")


def _arm_fit(spark, sf_dir):
    return mixed.fit_random_intercept(_first_scores(spark, sf_dir), "score", mixed.design({"arm": mixed.factor("arm", "MPCLA", "A")}, [("arm",)]))


_PAIRS = (("M vs P", "M", "P"), ("C vs M", "C", "M"), ("C vs P", "C", "P"), ("L vs M", "L", "M"), ("L vs P", "L", "P"), ("L vs C", "L", "C"))


@query("one_visit_contrasts", "M5", _FIRST_SQL + " union all ".join(
    f" select '{name}' as contrast, {sfix('a.m - b.m')} as estimate, {sfix('sqrt(s2 * (1 / a.n + 1 / b.n))')} as se from t, g a, g b where a.arm = '{x}' and b.arm = '{y}'"
    for name, x, y in _PAIRS))
def one_visit_contrasts(spark, sf_dir):
    rows = mixed.contrasts_table(spark, [_arm_fit(spark, sf_dir)])
    return rows.select("contrast", fixed("estimate").alias("estimate"), fixed("se").alias("se"))


@query("one_visit_f_test", "M4", _FIRST_SQL + f" select 'treat' as test, {sfix('sum(n * (m - grand) ** 2) / (any_value(k) - 1) / any_value(s2)')} as f_value, cast(any_value(k) - 1 as int) as q from g, t")
def one_visit_f_test(spark, sf_dir):
    rows = mixed.tests_table(spark, [_arm_fit(spark, sf_dir)])
    return rows.select("test", fixed("f_value").alias("f_value"), "q")


@query("one_visit_coefficients", "M1 M3", _FIRST_SQL + f""" select case when g.arm = 'A' then 'intercept' else 'arm[' || g.arm || ']' end as term,
  {sfix("g.m - case when g.arm = 'A' then 0 else a.m end")} as coef, {sfix("sqrt(s2 * (1 / a.n + case when g.arm = 'A' then 0 else 1 / g.n end))")} as se
from g, t, g a where a.arm = 'A'""")
def one_visit_coefficients(spark, sf_dir):
    rows = mixed.coef_table(spark, [_arm_fit(spark, sf_dir)])
    return rows.select("term", fixed("coef").alias("coef"), fixed("se").alias("se"))


# Two raters per subject, one mean each: a balanced layout, where REML has a closed form from subject means and rater gaps.
_BALANCED_SQL = _V + """, m as (select subject, rater, any_value(arm) as arm, avg(score) as y from visits where score is not null group by all),
w as (select subject, any_value(arm) as arm, max(y) filter (rater = 'Parent') + {effect} as p, max(y) filter (rater = 'Teacher') + {effect} as t
  from m group by subject having count(*) = 2),
g as (select arm, avg((p + t) / 2) as m, var_samp((p + t) / 2) as v, count(*) as n from w group by arm),
b as (select 2 * sum((n - 1) * v) / (sum(n) - count(*)) as msb, sum(n * m) / sum(n) as grand, sum(n) as s, count(*) as k from g),
e as (select avg(t - p) as gap, var_samp(t - p) / 2 as msw from w) """
_SUBJECT_EFFECT = "subject % 10"


def _balanced_fit(spark, sf_dir):
    v = visits(spark, sf_dir).where("score is not null")
    means = v.groupBy("subject", "rater").agg(F.min("arm").alias("arm"), F.avg("score").alias("y"))
    both = means.groupBy("subject").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("subject")
    rows = means.join(both, "subject").withColumn("y", F.col("y") + F.col("subject") % 10)
    factors = {"arm": mixed.factor("arm", "MPCLA", "A"), "rater": mixed.factor("rater", ["Teacher", "Parent"], "Parent")}
    return mixed.fit_random_intercept(rows, "y", mixed.design(factors, [("arm",), ("rater",)]))


@query("balanced_variances", "M2", _BALANCED_SQL.format(effect=_SUBJECT_EFFECT) +
       f"select {sfix('(msb - msw) / (2 * msw)', 4)} as theta, {sfix('msw', 4)} as sigma2, cast(s as bigint) as subjects from b, e")
def balanced_variances(spark, sf_dir):
    fit = _balanced_fit(spark, sf_dir)
    row = spark.createDataFrame([(fit.theta, fit.sigma2, fit.groups)], "theta double, sigma2 double, subjects long")
    return row.select(fixed("theta", 4).alias("theta"), fixed("sigma2", 4).alias("sigma2"), "subjects")


@query("balanced_coefficients", "M1 M2 M3", _BALANCED_SQL.format(effect=_SUBJECT_EFFECT) + f"""
select 'arm[' || g.arm || ']' as term, {sfix('g.m - a.m', 4)} as coef, {sfix('sqrt(msb / 2 * (1 / g.n + 1 / a.n))', 4)} as se from g, g a, b where a.arm = 'A' and g.arm <> 'A'
union all select 'rater[Teacher]', {sfix('gap', 4)}, {sfix('sqrt(2 * msw / s)', 4)} from b, e
union all select 'intercept', {sfix('m - gap / 2', 4)}, {sfix('sqrt(msb / 2 / n + msw / 2 / s)', 4)} from g, b, e where arm = 'A'""")
def balanced_coefficients(spark, sf_dir):
    """The mixed model itself against its closed form: subjects differ, so the random intercept matters."""
    rows = mixed.coef_table(spark, [_balanced_fit(spark, sf_dir)])
    return rows.select("term", fixed("coef", 4).alias("coef"), fixed("se", 4).alias("se"))


@query("balanced_f_test", "M2 M4", _BALANCED_SQL.format(effect=_SUBJECT_EFFECT) +
       f"select 'treat' as test, {sfix('sum(n * (m - grand) ** 2) / (any_value(k) - 1) / (any_value(msb) / 2)', 4)} as f_value, cast(any_value(k) - 1 as int) as q from g, b")
def balanced_f_test(spark, sf_dir):
    rows = mixed.tests_table(spark, [_balanced_fit(spark, sf_dir)]).where("test = 'treat'")
    return rows.select("test", fixed("f_value", 4).alias("f_value"), "q")


@query("balanced_contrasts", "M2 M5", _BALANCED_SQL.format(effect=_SUBJECT_EFFECT) + " union all ".join(
    f" select '{name}' as contrast, {sfix('x.m - y.m', 4)} as estimate, {sfix('sqrt(msb / 2 * (1 / x.n + 1 / y.n))', 4)} as se from b, g x, g y where x.arm = '{x}' and y.arm = '{y}'"
    for name, x, y in _PAIRS))
def balanced_contrasts(spark, sf_dir):
    rows = mixed.contrasts_table(spark, [_balanced_fit(spark, sf_dir)])
    return rows.select("contrast", fixed("estimate", 4).alias("estimate"), fixed("se", 4).alias("se"))


@query("arm_contrasts", "M5 F17", None)
def arm_contrasts(spark, sf_dir):
    v = visits(spark, sf_dir)
    fit = mixed.fit_random_intercept(v, "score", mixed.design({"arm": mixed.factor("arm", "MPCLA", "A")}, [("arm",)]))
    a = mixed.contrasts_table(spark, [fit], kind="original", bonferroni=True)
    return a.unionByName(mixed.contrasts_table(spark, [fit], kind="orthogonal"))


@query("significant_terms_refit", "M6", None)
def significant_terms_refit(spark, sf_dir):
    v, factors = _trial(spark, sf_dir), replication.arm_factors(_SITES)
    fit = mixed.fit_random_intercept(v, "calm", mixed.design(factors, replication.TERMS))
    return mixed.coef_table(spark, [mixed.refit_significant(v, fit, "calm", factors)])


@query("moderator_models", "M7 M4 F19", None)
def moderator_models(spark, sf_dir):
    fits = mixed.fit_many(_trial(spark, sf_dir), mediators.moderator_specs(["anx"], ["score", "calm"], ["Parent", "Teacher"], _SITES))
    rows = [tuple(t.values()) for f in fits for t in mediators.moderator_tests(f, "anx")]
    return spark.createDataFrame(rows, "model_id string, test string, f_value double, p_value double, q int, significant boolean")


# Coefficients of a stated linear rule.
_STATED = {"intercept": 1.5, "arm[M]": 0.25, "arm[P]": -0.5, "day": 0.001, "arm[M]:day": -0.002, "arm[P]:day": 0.004}


@query("fixed_predictions", "M8", _V + f"""select visit_id, {sfix("1.5 + 0.25 * (arm = 'M')::int - 0.5 * (arm = 'P')::int + 0.001 * day - 0.002 * (arm = 'M')::int * day + 0.004 * (arm = 'P')::int * day")} as predicted from visits""")
def fixed_predictions(spark, sf_dir):
    factors = {"arm": mixed.factor("arm", "MPA", "A"), "day": mixed.numeric("day")}
    terms = mixed.design(factors, mixed.crossed(["arm", "day"]))
    fit = mixed.Fit("stated", [n for n, _ in terms], "ok", beta=np.array([_STATED[n] for n, _ in terms]))
    return mixed.predict_fixed(visits(spark, sf_dir), fit, terms).select("visit_id", fixed("predicted").alias("predicted"))


@query("moderator_slopes", "M9", None)
def moderator_slopes(spark, sf_dir):
    fits = mixed.fit_many(_trial(spark, sf_dir), mediators.moderator_specs(["anx"], ["calm"], ["Parent"], _SITES))
    rows = [(s["arm"], s["no_mod"], s["yes_mod"]) for s in mixed.slopes(fits[0], "anx")]
    return spark.createDataFrame(rows, "arm string, no_mod double, yes_mod double")


@query("outcome_definitions", "M10 G8", None)
def outcome_definitions(spark, sf_dir):
    return mixed.coef_table(spark, [mixed.compare_outcomes(_trial(spark, sf_dir), ["score", "calm"], "M", 500)])


# Published F and p of a small part of the outcome table.
_PUBLISHED = [("Inattention", "Teacher", "time_treat", 10.6, "<.001"), ("Inattention", "Parent", "time_treat", 21.5, "<.001"),
              ("Inattention", "Teacher", "site", 2.7, ".02"), ("Inattention", "Parent", "site", 3.0, ".02")]


@query("published_and_replicated", "M11 F18 F5", None)
def published_and_replicated(spark, sf_dir):
    from armwave.functions import numbers, text

    published = spark.createDataFrame(_PUBLISHED, "measure string, rater string, test string, f_value double, p_value string")
    fits = replication.fit_replication(_trial(spark, sf_dir), ["score"], ["Parent", "Teacher"], _SITES, 500)
    filled = replication.replicated_results(published, fits, [("natten", "score")])
    return filled.withColumn("agreement", numbers.agreement(text.p_significant("p_value"), F.col("replicated_p") < 0.05))


# ---- curves -------------------------------------------------------------------------------------

@query("lowess_curves", "K1", None)
def lowess_curves(spark, sf_dir):
    return curves.lowess(visits(spark, sf_dir), "score", 0.1, ["arm"])


_TP = (0, 100, 200, 300, 400)


def _det(a, b, c, d, e, f, g, h, i):
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_D = _det("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")


@query("quadratic_curves", "K2 W6", _V + f""", p as (select arm, avg(day) as x, avg(score) as y from visits
  join (values {', '.join(f'({t})' for t in _TP)}) t(t) on day >= t.t - 45 and day < t.t + 45 group by arm, t.t having avg(score) is not null),
c as (select arm, avg(x) as c, min(x) as lo, max(x) as hi from p group by arm having count(*) > 2),
u as (select p.arm, c, lo, hi, y, (x - c) / (hi - lo) as u from p join c on p.arm = c.arm),
m as (select arm, c, lo, hi, cast(count(*) as double) as s0, sum(u) as s1, sum(u**2) as s2, sum(u**3) as s3, sum(u**4) as s4,
  sum(y) as t0, sum(u * y) as t1, sum(u**2 * y) as t2 from u group by arm, c, lo, hi),
k as (select arm, c, lo, hi, {_det('t0', 's1', 's2', 't1', 's2', 's3', 't2', 's3', 's4')} / {_D} as a0,
  {_det('s0', 't0', 's2', 's1', 't1', 's3', 's2', 't2', 's4')} / {_D} as a1, {_det('s0', 's1', 't0', 's1', 's2', 't1', 's2', 's3', 't2')} / {_D} as a2 from m),
g as (select *, cast(unnest(range(100)) as int) as step from k)
select arm, step, {sfix('lo + (hi - lo) * step / 99.0::double')} as x,
  {sfix('a0 + a1 * ((lo + (hi - lo) * step / 99.0::double - c) / (hi - lo)) + a2 * ((lo + (hi - lo) * step / 99.0::double - c) / (hi - lo)) ** 2')} as smoothed from g""")
def quadratic_curves(spark, sf_dir):
    points = waves.point_avg(visits(spark, sf_dir), "score", _TP, 45, ["arm"])
    curve = curves.poly2(points, ["arm"], "mean_day", "mean_y")
    return curve.select("arm", "step", fixed("x").alias("x"), fixed("smoothed").alias("smoothed"))


@query("exponential_fits", "K3", None)
def exponential_fits(spark, sf_dir):
    v = visits(spark, sf_dir).withColumn("decay", F.col("score") * F.exp(-F.col("day") / 150) + 1)
    points = waves.point_avg_balanced(v, "decay", (50, 100, 200, 300, 400), 45, ["arm"])
    return curves.exp_fit(points, ["arm"], start=(1.0, 0.01, 1.0))


# Points on a stated curve per arm, at the hundreds of days of its visits: the fit must return the constants.
@query("exponential_constants", "K3", _V + f"""select arm, {sfix("1.5 + ascii(arm) % 5", 3)} as a, {sfix("0.004", 3)} as b, {sfix("0.5", 3)} as c
from (select distinct arm, day // 100 * 100 as x from visits) group by arm having count(*) >= 4""")
def exponential_constants(spark, sf_dir):
    points = visits(spark, sf_dir).select("arm", (F.floor(F.col("day") / 100) * 100).alias("day")).distinct()
    y = (F.lit(1.5) + F.ascii("arm") % 5) * F.exp(-0.004 * F.col("day")) + 0.5
    fit = curves.exp_fit(points.withColumn("mean_y", y), ["arm"], start=(1.0, 0.01, 1.0))
    return fit.select("arm", *[fixed(F.col(c) + 1e-7, 3).alias(c) for c in "abc"])


@query("curve_counts", "K5", _V + """select arm, subject % 2 as anx, t.t as timepoint, cast(count(score) as bigint) as n
from visits, (select unnest([0, 100, 250, 400]) as t) t where day >= t.t - 45 and day < t.t + 45 group by all""")
def curve_counts(spark, sf_dir):
    v = visits(spark, sf_dir).withColumn("anx", F.col("subject") % 2)
    return curves.curve_counts(v, "score", (0, 100, 250, 400), 45, ["arm", "anx"])


@query("moderator_curves", "K5 K4 P22 W7", None)
def moderator_curves(spark, sf_dir):
    return mediators.moderator_curves(_trial(spark, sf_dir), "score", "anx", ([0], [1]), (0, 100, 250, 400), 45, 50)


# ---- features -----------------------------------------------------------------------------------

_WIDE_SQL = _V + """, pred as (select subject, any_value(arm) as arm, avg(score) filter (rater = 'Parent') as snap_score_m, avg(score) filter (rater = 'Teacher') as snap_score_t,
  max(day) as snap_day_c, avg(score) filter (day > 2000) as snap_rare_m, max('k') as snap_same_c from visits group by subject),
outc as (select subject, arg_max(score, visit_id) filter (score is not null) as snap_last_m, count(*) filter (rater = 'Teacher') as snap_count_t from visits group by subject)"""


def _wide(spark, sf_dir):
    v = visits(spark, sf_dir)

    def mean(test):
        return F.avg(F.when(test, F.col("score")))

    pred = v.groupBy("subject").agg(
        F.min("arm").alias("arm"), mean(F.col("rater") == "Parent").alias("snap_score_m"), mean(F.col("rater") == "Teacher").alias("snap_score_t"),
        F.max("day").alias("snap_day_c"), mean(F.col("day") > 2000).alias("snap_rare_m"), F.max(F.lit("k")).alias("snap_same_c"))
    out = v.groupBy("subject").agg(
        F.max(F.when(F.col("score").isNotNull(), F.struct("visit_id", "score")))["score"].alias("snap_last_m"),
        F.count_if(F.col("rater") == "Teacher").alias("snap_count_t"))
    return pred, out


@query("prepared_features", "L1 P9 P10 J2 A7 P7", _WIDE_SQL + f""" select subject, arm, {sfix('snap_last_m')} as snap_last_m_out, {sfix('snap_score_m')} as snap_score_m, snap_day_c
from outc join pred using (subject) where snap_last_m is not null""")
def prepared_features(spark, sf_dir):
    pred, out = _wide(spark, sf_dir)
    data, y = features.prepare_data(pred, out, "snap_last", "m", "m", 50)
    return data.withColumns({y: fixed(y), "snap_score_m": fixed("snap_score_m")})


# Variable names and types of the typing table.
_TYPES = [("snap_score", "num"), ("snap_rare", "num"), ("snap_day", "ord"), ("snap_count", "cat")]


@query("variable_types", "L2", """
select distinct p_name as name, t.type from part join (values ('red', 'num'), ('ring', 'ord'), ('bolt', 'cat')) t(v, type) on contains(p_name, t.v)""")
def variable_types(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return features.assign_types(names, [("red", "num"), ("ring", "ord"), ("bolt", "cat")])


@query("scaled_numbers", "L3", _V + f""", s as (select avg(score) as m, sqrt(var_pop(score) * count(score) / count(*)) as sd from visits)
select visit_id, {sfix('(coalesce(score, m) - m) / sd')} as score from visits, s""")
def scaled_numbers(spark, sf_dir):
    v = visits(spark, sf_dir).select("visit_id", "score")
    scaled = features.MeanScaler(inputCols=["score"]).fit(v).transform(v)
    return scaled.select("visit_id", fixed("score__scaled").alias("score"))


@query("imputed_ordinals", "L4", _V + f"select visit_id, {sfix('coalesce(score, (select avg(score) from visits))')} as score from visits")
def imputed_ordinals(spark, sf_dir):
    from pyspark.ml.feature import Imputer

    v = visits(spark, sf_dir).select("visit_id", "score")
    done = Imputer(strategy="mean", inputCols=["score"], outputCols=["filled"]).fit(v).transform(v)
    return done.select("visit_id", fixed("filled").alias("score"))


def _model_rows(spark, sf_dir):
    """Rows, kinds of features and label of the tree models: one row per visit, grouped by subject."""
    v = visits(spark, sf_dir).where("score is not null").withColumn("label", F.col("score") + F.col("day") / 1000 + F.when(F.col("arm") == "M", -1.0).otherwise(0.0))
    v = v.select("visit_id", "subject", "label", "day", (F.col("day") * 2 + F.col("site")).alias("late"), waves.log_days("day").alias("log_day"),
                 F.when(F.col("visit_id") % 10 != 0, F.col("arm")).alias("arm"), F.when(F.col("visit_id") % 9 != 0, F.col("site")).alias("site"), "rater")
    kinds = {"num": ["day", "late"], "ord": ["log_day"], "cat_str": ["arm", "rater"], "cat_num": ["site"]}
    return features.fill_categories(v, kinds["cat_str"], kinds["cat_num"]), kinds


def _vectors(spark, sf_dir, corr_threshold=None, folds=5):
    rows, kinds = _model_rows(spark, sf_dir)
    done = features.feature_pipeline(kinds, corr_threshold).fit(rows).transform(rows)
    return models.settled(features.group_folds(done.select("visit_id", "subject", "label", "features"), "subject", folds))


@query("filled_categories", "L5 L6", _V + """
select visit_id, coalesce(case when visit_id % 10 <> 0 then arm end, 'missing') as arm, coalesce(case when visit_id % 9 <> 0 then cast(site as double) end, -1.0::double)::varchar as site
from visits where score is not null""")
def filled_categories(spark, sf_dir):
    return _model_rows(spark, sf_dir)[0].select("visit_id", "arm", "site")


@query("feature_vectors", "L5 L6 L7 C13", None)
def feature_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows, kinds = _model_rows(spark, sf_dir)
    done = features.feature_pipeline(kinds, 0.8).fit(rows).transform(rows)
    return done.select("visit_id", vector_to_array("features").alias("features"))


_KNN_COLS = ("c_acctbal", "c_nationkey", "c_block")
_KNN_SQL = """c as (select c_custkey, case when c_custkey % 11 <> 0 then c_acctbal / 100 end as c_acctbal, case when c_custkey % 13 <> 0 then cast(c_nationkey as double) end as c_nationkey,
  cast(c_custkey % 7 as double) as c_block from customer)"""


def _knn_target(t):
    gaps = {c: f"(q.{c} - d.{c}) ** 2" for c in _KNN_COLS if c != t}
    shared = " + ".join(f"(q.{c} is not null and d.{c} is not null)::int" for c in gaps)
    dist = " + ".join(f"coalesce({g}, 0)" for g in gaps.values())
    return f"""(select k, avg(v) as v from (select q.c_custkey as k, d.{t} as v, row_number() over (partition by q.c_custkey order by ({dist}) * 3 / ({shared}), d.c_custkey) as r
  from c q join c d on q.{t} is null and d.{t} is not null and ({shared}) > 0) where r <= 5 group by k)"""


@query("neighbour_imputation", "L8", "with " + _KNN_SQL + f"""
select c.c_custkey, {sfix('coalesce(c.c_acctbal, a.v)')} as c_acctbal, {sfix('coalesce(c.c_nationkey, n.v)')} as c_nationkey, c.c_block
from c left join {_knn_target('c_acctbal')} a on a.k = c.c_custkey left join {_knn_target('c_nationkey')} n on n.k = c.c_custkey""")
def neighbour_imputation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 100).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_nationkey").cast("double")).alias("c_nationkey"), (F.col("c_custkey") % 7).cast("double").alias("c_block"))
    done = features.knn_impute(c, _KNN_COLS, "c_custkey", 5)
    return done.withColumns({"c_acctbal": fixed("c_acctbal"), "c_nationkey": fixed("c_nationkey")})


@query("label_encoding", "L9", "select p_partkey, cast(dense_rank() over (order by p_type) - 1 as double) as p_type_index, cast(dense_rank() over (order by p_brand) - 1 as double) as p_brand_index from part")
def label_encoding(spark, sf_dir):
    return features.encode(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"]).drop("p_type", "p_brand")


@query("subject_split", "L10", _V + "select visit_id, subject, cast('0x' || substr(md5('42|' || subject), 1, 8) as bigint) / 4294967296.0::double < 0.2 as is_test from visits")
def subject_split(spark, sf_dir):
    return features.group_split(visits(spark, sf_dir).select("visit_id", "subject"), "subject", 0.2, 42)


@query("group_fold_loads", "L11", _V + """, recursive_input as (select subject, count(*) as n, row_number() over (order by count(*) desc, subject) as i from visits group by subject),
steps as (with recursive s as (select 1::bigint as i, [0, 0, 0, 0, 0]::bigint[] as loads, [0, 0, 0, 0, 0]::bigint[] as counts
  union all select s.i + 1, list_transform(range(1, 6), lambda f: s.loads[f] + case when f = list_position(s.loads, list_min(s.loads)) then r.n else 0 end),
    list_transform(range(1, 6), lambda f: s.counts[f] + case when f = list_position(s.loads, list_min(s.loads)) then 1 else 0 end) from s join recursive_input r on r.i = s.i) select * from s),
last as (select * from steps order by i desc limit 1)
select cast(unnest(range(5)) as int) as fold, unnest(counts) as n_subjects, unnest(loads) as n_rows from last""")
def group_fold_loads(spark, sf_dir):
    f = features.group_folds(visits(spark, sf_dir), "subject", 5)
    return f.groupBy("fold").agg(F.count_distinct("subject").alias("n_subjects"), F.count(F.lit(1)).alias("n_rows"))


# ---- tree models --------------------------------------------------------------------------------

# One tree of depth 1 on one number, without resampling, is the split with the least squared error in the training folds.
_STUMP_SQL = _V + f""", v as (select subject % 3 as fold, site, score as y from visits where score is not null),
g as (select fold, site, count(*) as n, sum(y) as s, sum(y * y) as q from v group by all),
f as (select distinct fold from v),
c as (select f.fold, t.t, sum(n) filter (site <= t.t) as nl, sum(s) filter (site <= t.t) as sl, sum(n) filter (site > t.t) as nr, sum(s) filter (site > t.t) as sr
  from f, g, (select unnest(range(1, 6)) as t) t where g.fold <> f.fold group by all),
b as (select fold, arg_max(t, sl * sl / nl + sr * sr / nr) as t, arg_max(sl / nl, sl * sl / nl + sr * sr / nr) as l, arg_max(sr / nr, sl * sl / nl + sr * sr / nr) as r from c group by fold)
select cast(fold as int) as fold, {sfix('1 - sum((y - case when site <= t then l else r end) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*))')} as r2,
  {sfix('avg((y - case when site <= t then l else r end) ** 2)')} as mse from v join b using (fold) group by fold"""


def _stump_scores(spark, sf_dir, estimator):
    from pyspark.ml.feature import VectorAssembler

    rows = visits(spark, sf_dir).where("score is not null").select((F.col("subject") % 3).cast("int").alias("fold"), F.col("score").alias("label"), "site")
    data = VectorAssembler(inputCols=["site"], outputCol="features").transform(rows)
    return models.cross_validate(data, estimator)[0].select("fold", fixed("r2").alias("r2"), fixed("mse").alias("mse"))


@query("forest_stump_validation", "L12 L16 L17", _STUMP_SQL)
def forest_stump_validation(spark, sf_dir):
    return _stump_scores(spark, sf_dir, models.rf({"n_estimators": 1, "max_depth": 1, "bootstrap": False}))


@query("boosted_stump_validation", "L13 L16 L17", _STUMP_SQL)
def boosted_stump_validation(spark, sf_dir):
    return _stump_scores(spark, sf_dir, models.gbt({"n_estimators": 1, "max_depth": 1}))


def _folds(spark, sf_dir, folds=5):
    """Rows of the tree models with their folds, and the pipeline that every fold fits for itself."""
    rows, kinds = _model_rows(spark, sf_dir)
    return models.settled(features.group_folds(rows, "subject", folds)), features.feature_pipeline(kinds)


def _splits(spark, sf_dir):
    rows, pipeline = _folds(spark, sf_dir)
    return ensembles.fold_splits(rows, "visit_id", range(5), pipeline)


@query("forest_validation", "L12 L16 L17 L7", None)
def forest_validation(spark, sf_dir):
    return ensembles.cross_validate(_splits(spark, sf_dir), growing.forest())[0]


@query("boosted_validation", "L13 L16 L7", None)
def boosted_validation(spark, sf_dir):
    growth = growing.boosted({"n_estimators": 100, "max_depth": 10, "colsample_bytree": 0.5, "min_child_weight": 2})
    return ensembles.cross_validate(_splits(spark, sf_dir), growth)[0]


# A tree of depth 2 without resampling, written out: the best cut of each fold's training rows, then the best cut of either side.
_CUTS = """select fold, {side} feature, cut, gl * gl / nl + gr * gr / nr - (gl + gr) * (gl + gr) / (nl + nr) as gain, gl / nl as lo, gr / nr as hi from (
  select g.fold, {side} c.feature, c.cut, sum(s) filter (v <= c.cut) as gl, sum(n) filter (v <= c.cut) as nl, sum(s) filter (v > c.cut) as gr, sum(n) filter (v > c.cut) as nr
  from {sums} g join cuts c on c.feature = g.feature group by all) where nl > 0 and nr > 0"""
_TREE_SQL = _V + f""", v as (select visit_id, subject % 3 as fold, site, case when rater = 'Teacher' then 1 else 0 end as teacher, round(score * 1024) as y from visits where score is not null),
f as (select distinct fold from v), t as (select f.fold, v.* exclude (fold) from v, f where v.fold <> f.fold),
cuts as (select 'site' as feature, unnest(range(1, 6)) as cut union all select 'teacher', 0),
g1 as (select fold, feature, v, count(*) as n, sum(y) as s from (select fold, y, unnest([{{'feature': 'site', 'v': site}}, {{'feature': 'teacher', 'v': teacher}}], recursive := true) from t) group by all),
r1 as ({_CUTS.format(side='', sums='g1')}), b1 as (select * from r1 qualify row_number() over (partition by fold order by gain desc, feature, cut) = 1),
s1 as (select t.*, case when (case b1.feature when 'site' then t.site else t.teacher end) <= b1.cut then 0 else 1 end as side from t join b1 using (fold)),
g2 as (select fold, side, feature, v, count(*) as n, sum(y) as s from (select fold, side, y, unnest([{{'feature': 'site', 'v': site}}, {{'feature': 'teacher', 'v': teacher}}], recursive := true) from s1) group by all),
r2 as ({_CUTS.format(side='side,', sums='g2')}), b2 as (select * from r2 qualify row_number() over (partition by fold, side order by gain desc, feature, cut) = 1),
h as (select v.*, case when (case b1.feature when 'site' then v.site else v.teacher end) <= b1.cut then 0 else 1 end as side from v join b1 using (fold)),
p as (select h.fold, h.y, case when (case b2.feature when 'site' then h.site else h.teacher end) <= b2.cut then b2.lo else b2.hi end as p from h join b2 using (fold, side))
select cast(fold as int) as fold, count(*) as n, {sfix('avg((y - p) ** 2)', 4)} as mse, {sfix('avg(abs(y - p))', 4)} as mae, {sfix('1 - avg((y - p) ** 2) / var_pop(y)')} as r2 from p group by fold"""


def _two_features(spark, sf_dir):
    """Site and rater as features, a whole number as label, three folds."""
    from pyspark.ml.feature import VectorAssembler

    rows = visits(spark, sf_dir).where("score is not null").select(
        "visit_id", (F.col("subject") % 3).cast("int").alias("fold"), F.rint(F.col("score") * 1024).alias("label"), "site", F.when(F.col("rater") == "Teacher", 1).otherwise(0).alias("teacher"))
    data = VectorAssembler(inputCols=["site", "teacher"], outputCol="features").transform(rows)
    return ensembles.fold_splits(data, "visit_id", range(3))


def _cut_metrics(scores):
    return scores.select("fold", "n", fixed("mse", 4).alias("mse"), fixed("mae", 4).alias("mae"), fixed("r2").alias("r2"))


@query("tree_of_two_levels", "L12 L16 L17", _TREE_SQL)
def tree_of_two_levels(spark, sf_dir):
    growth = growing.forest({"n_estimators": 1, "max_depth": 2, "bootstrap": False})
    return _cut_metrics(ensembles.cross_validate(_two_features(spark, sf_dir), growth)[0])


# Two boosted stumps with a penalty of 2 and half steps: the second one is fitted to what the first leaves over.
def _stump(sums, name):
    return f"""{name}_r as (select fold, feature, cut, gl, nl, gr, nr, gl * gl / (nl + 2.0) + gr * gr / (nr + 2.0) as gain from (
  select g.fold, c.feature, c.cut, sum(s) filter (v <= c.cut) as gl, sum(n) filter (v <= c.cut) as nl, sum(s) filter (v > c.cut) as gr, sum(n) filter (v > c.cut) as nr
  from {sums} g join cuts c on c.feature = g.feature group by all) where nl > 0 and nr > 0),
{name} as (select fold, feature, cut, 0.5 * gl / (nl + 2.0) as lo, 0.5 * gr / (nr + 2.0) as hi from {name}_r qualify row_number() over (partition by fold order by gain desc, feature, cut) = 1)"""


def _sums(source):
    return f"""select fold, feature, v, cast(count(*) as double) as n, sum(y - m) as s from (select fold, y, m, unnest([{{'feature': 'site', 'v': site}}, {{'feature': 'teacher', 'v': teacher}}], recursive := true) from {source}) group by all"""


def _after(source, stump):
    return f"select x.* exclude (m), m + case when (case b.feature when 'site' then x.site else x.teacher end) <= b.cut then b.lo else b.hi end as m from {source} x join {stump} b using (fold)"


_BOOST_SQL = _V + f""", v as (select visit_id, subject % 3 as fold, site, case when rater = 'Teacher' then 1 else 0 end as teacher, round(score * 1024) as y from visits where score is not null),
f as (select distinct fold from v), base as (select f.fold, avg(y) as m from v, f where v.fold <> f.fold group by f.fold),
t0 as (select f.fold, v.* exclude (fold), m from v, f join base using (fold) where v.fold <> f.fold), h0 as (select v.*, m from v join base using (fold)),
cuts as (select 'site' as feature, unnest(range(1, 6)) as cut union all select 'teacher', 0),
g1 as ({_sums('t0')}), {_stump('g1', 'b1')}, t1 as ({_after('t0', 'b1')}), h1 as ({_after('h0', 'b1')}),
g2 as ({_sums('t1')}), {_stump('g2', 'b2')}, p as ({_after('h1', 'b2')})
select cast(fold as int) as fold, count(*) as n, {sfix('avg((y - m) ** 2)', 2)} as mse, {sfix('avg(abs(y - m))', 2)} as mae, {sfix('1 - avg((y - m) ** 2) / var_pop(y)', 5)} as r2 from p group by fold"""


@query("two_boosted_stumps", "L13 L16 L17", _BOOST_SQL)
def two_boosted_stumps(spark, sf_dir):
    growth = growing.boosted({"n_estimators": 2, "max_depth": 1, "learning_rate": 0.5, "reg_lambda": 2.0})
    scores = ensembles.cross_validate(_two_features(spark, sf_dir), growth)[0]
    return scores.select("fold", "n", fixed("mse", 2).alias("mse"), fixed("mae", 2).alias("mae"), fixed("r2", 5).alias("r2"))


def _searched(spark, sf_dir, kind, grid, name):
    found = ensembles.search(_splits(spark, sf_dir), ensembles.drawn(grid, 10), kind)
    info = {"model": name, "cv": "group 5-fold", "outcome": "label", "input": "all", "selection": "none", "threshold": 50}
    return models.result_row(found.folds, info, found.best)


@query("searched_forest", "L14 L23 L7", None)
def searched_forest(spark, sf_dir):
    return _searched(spark, sf_dir, "forest", models.FOREST_GRID, "RandomForestRegressor")


@query("searched_boosted", "L13 L14 L23 L7", None)
def searched_boosted(spark, sf_dir):
    return _searched(spark, sf_dir, "boosted", models.BOOSTED_GRID, "XGBRegressor")


def _nested(spark, sf_dir, kind, grid, corr_threshold=None):
    rows, kinds = _model_rows(spark, sf_dir)
    rows = models.settled(features.group_folds(rows, "subject", 5))
    found = ensembles.nested(rows, "visit_id", "subject", ensembles.combinations(grid), kind, features.feature_pipeline(kinds, corr_threshold))
    return spark.createDataFrame([(r["fold"], models.params_text(r["params"]), r["rmse"], r["r2"]) for r in found], "fold int, params string, rmse double, r2 double")


@query("nested_validation", "L15 G15 L7", None)
def nested_validation(spark, sf_dir):
    """All 32 settings of the boosted grid, 3 inner folds in each of 5 outer ones."""
    return _nested(spark, sf_dir, "boosted", ensembles.NESTED_BOOSTED)


@query("nested_forest_validation", "L15 G15 L7 C13", None)
def nested_forest_validation(spark, sf_dir):
    """All 216 settings of the forest grid, features selected by correlation inside every split."""
    return _nested(spark, sf_dir, "forest", ensembles.NESTED_FOREST, 0.8)


@query("prediction_metrics", "L17", _V + f""", p as (select arm, score as y, 2.5 + day / 1000 as p from visits where score is not null)
select arm, count(*) as n, {sfix('avg((y - p) ** 2)')} as mse, {sfix('sqrt(avg((y - p) ** 2))')} as rmse, {sfix('avg(abs(y - p))')} as mae,
  {sfix('1 - avg((y - p) ** 2) / var_pop(y)')} as r2 from p group by arm""")
def prediction_metrics(spark, sf_dir):
    p = visits(spark, sf_dir).withColumn("p", F.lit(2.5) + F.col("day") / 1000)
    m = models.metrics(p, "score", "p", ["arm"])
    return m.withColumns({c: fixed(c) for c in ("mse", "rmse", "mae", "r2")})


@query("run_table_row", "L23 F13 F10", _V + """, p as (select rater as fold, score as y, 2.5 + day / 1000 as p from visits where score is not null),
m as (select fold, avg((y - p) ** 2) as mse, sqrt(avg((y - p) ** 2)) as rmse, avg(abs(y - p)) as mae, 1 - avg((y - p) ** 2) / var_pop(y) as r2 from p group by fold)
select 'linear rule' as model, 'by rater' as cross_validation, concat('intercept: 2.5', chr(10), 'slope: 0.001') as params, """ + ", ".join(
    f"case when avg({c}) < 0 then -(floor(abs(avg({c})) * 1e4) / 1e4) else floor(abs(avg({c})) * 1e4) / 1e4 end as {c}" for c in ("mse", "rmse", "mae", "r2"))
       + ", 'score' as outcome, 'all' as input, 'none' as feature_selection, 50 as threshold from m")
def run_table_row(spark, sf_dir):
    p = visits(spark, sf_dir).withColumn("p", F.lit(2.5) + F.col("day") / 1000)
    info = {"model": "linear rule", "cv": "by rater", "outcome": "score", "input": "all", "selection": "none", "threshold": 50}
    return models.result_row(models.metrics(p, "score", "p", ["rater"]), info, {"intercept": 2.5, "slope": 0.001})


@query("permutation_statistics", "L18", f"""
with a as (select avg(r) as m from (select avg(p_retailprice) - 60 as r from part group by p_size % 5)), p as (select p_retailprice / 1.1 as s from part)
select count(*) as n, {sfix('any_value(m)', 4)} as mean_score, {sfix('avg((s >= m)::int)')} as p_value, {sfix('avg(s)', 4)} as perm_mean, {sfix('stddev_samp(s)', 4)} as perm_sd,
  {sfix('(any_value(m) - avg(s)) / stddev_samp(s)')} as z_score, {sfix('100 * avg((s < m)::int)')} as percentile, {sfix('quantile_cont(s, 0.025)', 4)} as ci_low, {sfix('quantile_cont(s, 0.975)', 4)} as ci_high from p, a""")
def permutation_statistics(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    actual = part.groupBy((F.col("p_size") % 5).alias("fold")).agg((F.avg("p_retailprice") - 60).alias("r2"))
    stats = models.permutation_stats(actual, part.select((F.col("p_retailprice") / 1.1).alias("r2")))
    wide = ("mean_score", "perm_mean", "perm_sd", "ci_low", "ci_high")
    return stats.withColumns({c: fixed(c, 4) for c in wide}).withColumns({c: fixed(c) for c in ("p_value", "z_score", "percentile")})


@query("permutation_test", "L18 L19", None)
def permutation_test(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression

    data = _vectors(spark, sf_dir)
    actual, permuted = models.permutation_scores(data, LinearRegression(featuresCol="features", labelCol="label", solver="normal", regParam=0.01), "visit_id", n_permutations=1000)
    return models.permutation_stats(actual, permuted)


@query("boosted_permutation_test", "L18 L19 L13 L7", None)
def boosted_permutation_test(spark, sf_dir):
    """100 permutations in each of 5 folds of the boosted pipeline, features prepared inside folds."""
    growth = growing.boosted({"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8})
    return models.permutation_stats(*ensembles.permutation_scores(_splits(spark, sf_dir), growth, 100))


@query("permuted_outcome", "L19", _V + """, v as (select visit_id, score from visits where score is not null),
r as (select visit_id, row_number() over (order by visit_id) as i from v),
h as (select score, row_number() over (order by md5('7|' || visit_id), visit_id) as i from v) select visit_id, score from r join h using (i)""")
def permuted_outcome(spark, sf_dir):
    v = visits(spark, sf_dir).where("score is not null").select("visit_id", "score")
    return models.permute(v, "score", "visit_id", 7).select("visit_id", "score")


@query("permutation_importance", "L20", None)
def permutation_importance(spark, sf_dir):
    """Forests of 100 trees of depth 10, 10 repeats on the held-out rows of each of 5 folds, averaged over folds."""
    data = _vectors(spark, sf_dir)
    folds = models.fold_values(data)
    splits = ensembles.fold_splits(data, "visit_id", folds)
    _, fitted = ensembles.cross_validate(splits, growing.forest({"n_estimators": 100, "max_depth": 10}), keep=True)
    size, cuts = splits.table.features[0], splits.table.cuts[0]
    tables = side_by_side(spark, [lambda f=f, i=i: importance.shuffled_drop(data.where(F.col("fold") == f), importance.grown_trees(fitted.trees(i), cuts), size, "visit_id", repeats=10)
                                  for i, f in enumerate(folds)])
    return models.mean_importance(tables)


@query("model_importances", "L21", None)
def model_importances(spark, sf_dir):
    return ensembles.importances(growing.binned(_vectors(spark, sf_dir), "visit_id"), growing.forest())


@query("refit_on_top_features", "L22 C10", None)
def refit_on_top_features(spark, sf_dir):
    """R2 per fold on all features, on the 3 most important ones, and without the 2 most important ones."""
    splits = ensembles.fold_splits(_vectors(spark, sf_dir), "visit_id", range(5))
    growth = growing.forest()
    slots = ensembles.ranked_slots(splits.table, growth)
    return ensembles.compared(splits, {"full": growth, "top": ensembles.on_slots(growth, slots[:3]), "cut": ensembles.on_slots(growth, slots[2:])})


@query("experiment_grid", "L24 L23 L1 L2 L7 S10", None)
def experiment_grid(spark, sf_dir):
    pred, out = _wide(spark, sf_dir)
    config = {"outcome": ["snap_last", "snap_absent"], "rater_out": ["m"], "rater_pred": [None, "m"], "model": ["forest", "boosted"], "corr_select": [True], "threshold": [50]}
    return experiments.run_grid(pred, out, config, _TYPES, folds=5, n_iter=10)


@query("day_clusters", "L25 G13", None)
def day_clusters(spark, sf_dir):
    return models.day_clusters(visits(spark, sf_dir), 4)[0]


@query("visit_positions", "W9 W10", _V + "select visit_id, row_number() over (partition by arm order by day, visit_id) - 1 as idx from visits")
def visit_positions(spark, sf_dir):
    return row_index(visits(spark, sf_dir).select("visit_id", "arm", "day"), "day", "visit_id", "idx", ["arm"]).select("visit_id", "idx")
