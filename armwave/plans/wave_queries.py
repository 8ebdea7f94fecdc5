"""Checked queries: time windows, one row per subject, rolling and point averages, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import ordering, waves
from armwave.plans.base import VISITS_SQL, table, user_flags, visits
from armwave.plans.base import FLAGS_SQL
from armwave.plans.registry import query, sfix

_V = "with " + VISITS_SQL + " "


@query("cumulative_windows", "T1", _V + """
select visit_id, w.wave from visits join (values ('b', 46), ('14', 168), ('24', 319), ('36', 500)) w(wave, cut) on day < cut""")
def cumulative_windows(spark, sf_dir):
    return waves.split_waves(visits(spark, sf_dir)).select("visit_id", "wave")


@query("windows_with_baseline", "T2", _V + """
select visit_id, 'b' as wave from visits where day = 0
union all select visit_id, w.wave from visits join (values ('14', 578), ('24', 912), ('36', 1195)) w(wave, cut) on day < cut""")
def windows_with_baseline(spark, sf_dir):
    return waves.split_waves(visits(spark, sf_dir), waves.LONG_CUTS, baseline="b").select("visit_id", "wave")


@query("custom_windows", "T3", _V + """
select visit_id, 'range' as how, w.t as wave from visits join (values (0), (168), (319)) w(t)
  on (w.t = 0 and day = 0) or (w.t > 0 and day between w.t - 30 and w.t + 30)
union all select visit_id, 'gt', w.t from visits join (values (900), (1500)) w(t) on day > w.t""")
def custom_windows(spark, sf_dir):
    v = visits(spark, sf_dir)
    a = waves.split_waves_custom(v, [0, 168, 319], "range", 30).select("visit_id", F.lit("range").alias("how"), "wave")
    b = waves.split_waves_custom(v, [900, 1500], "gt").select("visit_id", F.lit("gt").alias("how"), "wave")
    return a.unionByName(b)


@query("day_bands", "T4", _V + """
select 'closed' as band, visit_id from visits where day >= 46 and day < 168
union all select 'open', visit_id from visits where day > 150 and day < 350""")
def day_bands(spark, sf_dir):
    v = visits(spark, sf_dir)
    a = waves.band(v, 46, 168).select(F.lit("closed").alias("band"), "visit_id")
    return a.unionByName(waves.band(v, 150, 350, open_low=True).select(F.lit("open").alias("band"), "visit_id"))


@query("log_day", "T5", _V + f"select visit_id, {sfix('coalesce(case when day - 40 > -1 then ln(day - 40 + 1) end, 0)')} as log_day from visits")
def log_day(spark, sf_dir):
    v = visits(spark, sf_dir).select("visit_id", (F.col("day") - 40).alias("day"))
    return v.select("visit_id", fixed(waves.log_days("day")).alias("log_day"))


@query("month_truncation", "T6", "select event_id, cast(date_trunc('month', ts) as date) as month from events")
def month_truncation(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", waves.month_of("ts").alias("month"))


@query("months_from_days", "T7", _V + "select visit_id, day / 30 as months from visits")
def months_from_days(spark, sf_dir):
    return visits(spark, sf_dir).select("visit_id", waves.days_to_months("day").alias("months"))


@query("one_row_per_subject", "W1", _V + """
select 'last' as pick, subject, visit_id, day, score from (select *, row_number() over (partition by subject order by day desc, visit_id) r from visits) where r = 1
union all select 'first', subject, visit_id, day, score from (select *, row_number() over (partition by subject order by day, visit_id) r
  from visits where day > 46) where r = 1""")
def one_row_per_subject(spark, sf_dir):
    v = visits(spark, sf_dir).select("subject", "visit_id", "day", "score")
    last = waves.one_per_subject(v, "subject", "max").withColumn("pick", F.lit("last"))
    return last.unionByName(waves.one_per_subject(v, "subject", "min", lower=46).withColumn("pick", F.lit("first")))


@query("one_row_per_window", "W2", _V + """
select wave, subject, visit_id, day from (select *, row_number() over (partition by w.wave, subject order by day desc, visit_id) r
  from visits join (values ('b', 46), ('14', 168), ('24', 319), ('36', 500)) w(wave, cut) on day < cut) where r = 1""")
def one_row_per_window(spark, sf_dir):
    v = visits(spark, sf_dir).select("subject", "visit_id", "day")
    return waves.one_per_subject_wave(v, "subject", select="max").select("wave", "subject", "visit_id", "day")


@query("duplicates_removed", "W3", """
with s as (select o_custkey * 7 % 9973 as key, o_orderkey, o_totalprice from orders)
select 'all' as mode, key, o_orderkey, o_totalprice from (select *, count(*) over (partition by key) n from s) where n = 1
union all select 'first', key, o_orderkey, o_totalprice from (select *, row_number() over (partition by key order by o_orderkey) r from s) where r = 1""")
def duplicates_removed(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 7 % 9973).alias("key"), "o_orderkey", "o_totalprice")
    gone = waves.drop_dups(s, "key", "o_orderkey").withColumn("mode", F.lit("all"))
    return gone.unionByName(waves.drop_dups(s, "key", "o_orderkey", "first").withColumn("mode", F.lit("first")))


@query("first_known_values", "W4", _V + """
select subject, arg_min(score, visit_id) filter (score is not null) as score,
  arg_min(rater, visit_id) filter (day > 200) as rater from visits group by subject""")
def first_known_values(spark, sf_dir):
    v = visits(spark, sf_dir).select("subject", "visit_id", "score", F.when(F.col("day") > 200, F.col("rater")).alias("rater"))
    return waves.first_entry(v, "subject", "visit_id", ["score", "rater"])


@query("rolling_mean_by_arm", "W5 K4", _V + f"""
select visit_id, arm, rater, {sfix('avg(score) over (partition by arm, rater order by day, visit_id rows between 49 preceding and current row)')} as smoothed
from visits""")
def rolling_mean_by_arm(spark, sf_dir):
    v = visits(spark, sf_dir).select("visit_id", "arm", "rater", "day", "score")
    return waves.rolling_mean(v, "score", 50, ["arm", "rater"]).select("visit_id", "arm", "rater", fixed("smoothed").alias("smoothed"))


@query("point_averages", "W6", _V + f"""
select arm, t.t as timepoint, {sfix('avg(day)')} as mean_day, {sfix('avg(score)')} as mean_y
from visits join (values (0), (100), (250), (400)) t(t) on day >= t.t - 45 and day < t.t + 45 group by arm, t.t""")
def point_averages(spark, sf_dir):
    p = waves.point_avg(visits(spark, sf_dir), "score", [0, 100, 250, 400], 45, ["arm"])
    return p.select("arm", "timepoint", fixed("mean_day").alias("mean_day"), fixed("mean_y").alias("mean_y"))


@query("balanced_point_averages", "W7", _V + f""", b as (
select arm, t.t as day, least(count(*) filter (v.day >= t.t - 45 and v.day < t.t), count(*) filter (v.day > t.t and v.day <= t.t + 45)) as m
from visits v, (values (0), (100), (250), (400)) t(t) group by arm, t.t)
select b.arm, b.day, {sfix('coalesce(avg(score) filter (v.day between b.day - m and b.day + m), avg(score) filter (v.day between b.day - 45 and b.day + 45))')} as mean_y
from b join visits v on v.arm = b.arm group by b.arm, b.day, m""")
def balanced_point_averages(spark, sf_dir):
    p = waves.point_avg_balanced(visits(spark, sf_dir), "score", [0, 100, 250, 400], 45, ["arm"])
    return p.select("arm", "day", fixed("mean_y").alias("mean_y"))


@query("average_ranks", "W8", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as rank from lineitem""")
def average_ranks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ordering.rank_avg(li, "l_quantity")


@query("average_ranks_by_arm", "W8", _V + """
select visit_id, arm, score, rank() over (partition by arm order by score) + (count(*) over (partition by arm, score) - 1) / 2 as rank
from visits where score is not null""")
def average_ranks_by_arm(spark, sf_dir):
    v = visits(spark, sf_dir).where("score is not null").select("visit_id", "arm", "score")
    return ordering.rank_avg(v, "score", by=["arm"])


@query("first_matching_row", "W9", """
select min(o_orderkey) as first_index from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'F'""")
def first_matching_row(spark, sf_dir):
    return ordering.first_match(table(spark, sf_dir, "orders"), "o_orderpriority", "5-LOW", "o_orderkey", F.col("o_orderstatus") == "F")


@query("padded_groups", "W10", """
with s as (select conv_id, turn, role from conversations), n as (select conv_id, count(*) n from s group by 1)
select conv_id, turn, role, cast(null as int) as slot from s
union all select conv_id, null, null, cast(unnest(range(n + 1, 7)) as int) from n where n < 6""")
def padded_groups(spark, sf_dir):
    return waves.pad_groups(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", 6)


@query("ordered_head", "O1 O2", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice, o_orderkey limit 200")
def ordered_head(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return ordering.head_rows(ordering.sort_rows(o, "o_orderkey"), 200, "o_totalprice", "o_orderkey")


@query("first_subject_groups", "O2", _V + "select subject, visit_id, day from visits where subject in (select distinct subject from visits order by subject limit 40)")
def first_subject_groups(spark, sf_dir):
    return ordering.first_groups(visits(spark, sf_dir).select("subject", "visit_id", "day"), "subject", 40)


@query("largest_rows", "O3", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15")
def largest_rows(spark, sf_dir):
    return ordering.top_k(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 15, "p_partkey")


@query("best_rows", "O4", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity = (select max(l_quantity) from lineitem)")
def best_rows(spark, sf_dir):
    return ordering.best_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("row_at_position", "O5", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 1 offset 7")
def row_at_position(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return ordering.nth_row(c, 7, F.col("c_acctbal").desc(), "c_custkey")


@query("flag_per_subject_window", "P21 W1", "with " + FLAGS_SQL + ", " + VISITS_SQL + """
select v.subject, v.visit_id, f.click from (select *, row_number() over (partition by subject order by day, visit_id) r from visits) v
join flags f on f.subject = v.subject where r = 1""")
def flag_per_subject_window(spark, sf_dir):
    first = waves.one_per_subject(visits(spark, sf_dir).select("subject", "visit_id", "day"), "subject")
    return first.join(user_flags(spark, sf_dir), "subject").select("subject", "visit_id", "click")
