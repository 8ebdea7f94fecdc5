"""Checked queries: descriptive tables and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import describe, waves
from armwave.plans.base import ITEMS_SQL, VISITS_SQL, items, table, visits
from armwave.plans.registry import query, sfix
from armwave.plans.replication import outcome_table

_V = "with " + VISITS_SQL + " "
_W = "join (values ('b', 46), ('14', 168), ('24', 319), ('36', 500)) w(wave, cut) on day < cut"


def _fixed_cols(df, *cols):
    return df.withColumns({c: fixed(c) for c in cols})


@query("outcome_by_arm_and_window", "G1 T1 J1", _V + f"""
select arm, wave, rater, 'score' as outcome, {sfix('avg(score)')} as mean, {sfix('stddev_samp(score)')} as sd, count(score) as n
from visits {_W} group by arm, wave, rater""")
def outcome_by_arm_and_window(spark, sf_dir):
    return _fixed_cols(outcome_table(visits(spark, sf_dir)), "mean", "sd")


@query("outcome_cells", "G2", _V + f"""
select arm, wave, rater, 'score' as outcome, coalesce(printf('%.2f', avg(score)), 'nan') || ' (' || coalesce(printf('%.2f', stddev_samp(score)), 'nan')
  || ') [' || count(score) || ']' as cell from visits {_W} group by arm, wave, rater""")
def outcome_cells(spark, sf_dir):
    v = waves.split_waves(visits(spark, sf_dir))
    return describe.summary_text(v, ["arm", "wave", "rater"], ["score"])


@query("continuous_summary", "G3", _V + f"""
select arm, count(score) as n, {sfix('avg(score)')} as mean, {sfix('stddev_samp(score)')} as sd,
  {sfix('stddev_samp(score) / sqrt(count(score))')} as se from visits group by arm""")
def continuous_summary(spark, sf_dir):
    s = describe.summary_cont(visits(spark, sf_dir), ["arm"], "score")
    return _fixed_cols(s, "mean", "sd", "se").drop("ci_low", "ci_high")


@query("continuous_intervals", "G3", None)
def continuous_intervals(spark, sf_dir):
    return describe.summary_cont(visits(spark, sf_dir), ["arm", "rater"], "score")


@query("value_counts", "G4", "select event_type, count(*) as n from events where value > 10 group by event_type")
def value_counts(spark, sf_dir):
    return describe.value_counts(table(spark, sf_dir, "events"), "event_type", F.col("value") > 10)


@query("value_counts_of_all", "G4", "select event_type, count(*) as n from events where event_type is not null group by event_type")
def value_counts_of_all(spark, sf_dir):
    return describe.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("repeated_subjects", "G5", "select count(*) as n_multi from (select o_custkey from orders group by 1 having count(*) > 1)")
def repeated_subjects(spark, sf_dir):
    return describe.multi_count(table(spark, sf_dir, "orders"), "o_custkey")


@query("dense_month_counts", "G6 T6", """
with e as (select cast(date_trunc('month', ts) as date) as month, event_type, case when user_id % 2 = 0 then 'F' else 'M' end as sex from events)
select k.month, k.event_type, s.sex, count(e.sex) as count from (select distinct month, event_type from e) k
cross join (values ('F'), ('M'), ('N')) s(sex) left join e on e.month = k.month and e.event_type = k.event_type and e.sex = s.sex
group by 1, 2, 3""")
def dense_month_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        waves.month_of("ts").alias("month"), "event_type", F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("sex"))
    return describe.dense_counts(e, ["month", "event_type"], "sex", ["F", "M", "N"])


@query("pivot_of_means", "G7", _V + f"""
select site, {sfix("avg(score) filter (arm = 'M')")} as "M", {sfix("avg(score) filter (arm = 'P')")} as "P",
  {sfix("avg(score) filter (arm = 'C')")} as "C" from visits group by site""")
def pivot_of_means(spark, sf_dir):
    return _fixed_cols(describe.pivot_mean(visits(spark, sf_dir), "site", "arm", ["M", "P", "C"], "score"), "M", "P", "C")


@query("melted_items", "G8", "with " + ITEMS_SQL + """
select l_orderkey, l_linenumber, l_partkey, variable, value from (unpivot (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax from items)
  on l_quantity, l_discount, l_tax into name variable value value) union all
select l_orderkey, l_linenumber, l_partkey, 'l_discount', null from items where l_discount is null union all
select l_orderkey, l_linenumber, l_partkey, 'l_tax', null from items where l_tax is null""")
def melted_items(spark, sf_dir):
    return describe.melt(items(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("day_histogram", "G9", _V + """
select arm, cast(least(day // 50, 8) as int) as bin, count(*) as n from visits where day between 0 and 450 group by 1, 2""")
def day_histogram(spark, sf_dir):
    return describe.histogram(visits(spark, sf_dir), "day", [50 * i for i in range(10)], ["arm"])


@query("box_statistics", "G10", _V + f"""
select arm, rater, count(score) as n, min(score) as min, max(score) as max, {sfix('quantile_cont(score, 0.25)')} as q1,
  {sfix('quantile_cont(score, 0.5)')} as median, {sfix('quantile_cont(score, 0.75)')} as q3 from visits group by arm, rater""")
def box_statistics(spark, sf_dir):
    return _fixed_cols(describe.box_stats(visits(spark, sf_dir), ["arm", "rater"], "score"), "q1", "median", "q3")


@query("non_null_counts", "G11", "with " + ITEMS_SQL + """
select 'l_discount' as "column", count(l_discount) as n from items union all select 'l_tax', count(l_tax) from items
union all select 'l_quantity', count(l_quantity) from items""")
def non_null_counts(spark, sf_dir):
    return describe.non_null_counts(items(spark, sf_dir), ["l_discount", "l_tax", "l_quantity"])


@query("subjects_per_arm", "G12", _V + "select arm, count(distinct subject) as n_subjects from visits where score is not null group by arm")
def subjects_per_arm(spark, sf_dir):
    return describe.n_subjects(visits(spark, sf_dir).where("score is not null"), ["arm"], "subject")


@query("label_bounds", "G13", "select label, min(vec_id) as low, max(vec_id) as high from embeddings group by label")
def label_bounds(spark, sf_dir):
    return describe.bounds(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query("mean_vectors", "G14", f"""
select label, list({sfix('m')} order by i) as embedding from (select label, i, avg(cast(v as double)) as m from (
  select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label""")
def mean_vectors(spark, sf_dir):
    m = describe.mean_vector(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return m.withColumn("embedding", F.transform("embedding", lambda v: fixed(v)))


@query("cv_score_summary", "G15", f"""
with s as (select o_orderpriority as model, o_orderstatus as params, o_totalprice / 1e6 as score from orders)
select t.model, {sfix('avg(score)')} as mean_score, {sfix('stddev_pop(score)')} as sd_score,
  (select params from s c where c.model = t.model group by params order by count(*) desc, params limit 1) as params from s t group by t.model""")
def cv_score_summary(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("params"), (F.col("o_totalprice") / 1e6).alias("score"))
    return _fixed_cols(describe.cv_summary(s, ["model"], "score", "params"), "mean_score", "sd_score")


@query("arm_means_in_order", "G16", _V + "select wave, rater, " + ", ".join(
    f"{sfix(f'avg(score) filter (arm = {chr(39)}{a}{chr(39)})')} as \"{a}\"" for a in "CMPL") + f" from visits {_W} group by wave, rater")
def arm_means_in_order(spark, sf_dir):
    m = describe.arm_means(waves.split_waves(visits(spark, sf_dir)), ["wave", "rater"], "score")
    return _fixed_cols(m, "C", "M", "P", "L")


@query("band_by_day", "G17", _V + f"""
select day, 'score' as variable, {sfix('avg(score)')} as mean, {sfix('stddev_samp(score)')} as sd, count(score) as n from visits group by day""")
def band_by_day(spark, sf_dir):
    long = describe.melt(visits(spark, sf_dir), ["day"], ["score"])
    return _fixed_cols(describe.band_by_day(long, ["day", "variable"]), "mean", "sd")


@query("group_size_report", "G18", "select count(*) as n_groups, max(n) as max_size from (select count(*) n from orders group by o_custkey)")
def group_size_report(spark, sf_dir):
    return describe.group_sizes(table(spark, sf_dir, "orders"), "o_custkey")


@query("conditional_counts", "G19", """
select count(*) filter (l_returnflag = 'R') as yes, count(*) filter (l_returnflag = 'N') as no,
  count(*) filter (l_linestatus = 'O' and l_quantity > 30) as named, count(*) filter (l_suppkey = 7) as one_subject from lineitem""")
def conditional_counts(spark, sf_dir):
    return describe.count_where(table(spark, sf_dir, "lineitem"), {
        "yes": F.col("l_returnflag") == "R", "no": F.col("l_returnflag") == "N",
        "named": (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 30), "one_subject": F.col("l_suppkey") == 7})
