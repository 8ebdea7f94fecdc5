"""Checked queries: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import joins
from armwave.plans.base import VISITS_SQL, subjects, table, visits
from armwave.plans.registry import query, sfix

_V = "with " + VISITS_SQL + " "


@query("arm_join", "J1", """
select o_orderkey, c_custkey as subject, c_mktsegment as arm from orders join customer on o_custkey = c_custkey""")
def arm_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"))
    arms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("arm"))
    return joins.attach_arm(o, arms)


@query("outcome_left_join", "J2", """
select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id""")
def outcome_left_join(spark, sf_dir):
    return joins.join_left(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


_SOURCES_SQL = """with a as (select o_custkey as subject, min(o_orderstatus) as s1 from orders where o_orderkey % 3 = 0 group by 1),
b as (select o_custkey as subject, min(o_orderstatus) as s2 from orders where o_orderkey % 3 = 1 group by 1),
c as (select o_custkey as subject, min(o_orderstatus) as s3 from orders where o_orderkey % 3 = 2 group by 1) """


def _sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "subject")
    return [o.where(F.col("o_orderkey") % 3 == i).groupBy("subject").agg(F.min("o_orderstatus").alias(f"s{i + 1}")) for i in range(3)]


@query("outer_join_sources", "J3", _SOURCES_SQL + "select subject, s1, s2, s3 from a full join b using (subject) full join c using (subject)")
def outer_join_sources(spark, sf_dir):
    return joins.outer_all(_sources(spark, sf_dir), "subject")


@query("inner_join_sources", "J4", _SOURCES_SQL + "select subject, s1, s2, s3 from a join b using (subject) join c using (subject)")
def inner_join_sources(spark, sf_dir):
    return joins.join_all(_sources(spark, sf_dir), "subject")


@query("instrument_join", "J5 J13", """
select p_partkey, p_retailprice, l_orderkey, l_extendedprice from part join lineitem on p_partkey = l_partkey""")
def instrument_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_extendedprice")
    return joins.join_inner(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), li, "p_partkey")


@query("semi_join", "J6", "select c_custkey, c_name from customer where c_custkey in (select user_id from events where event_type = 'error')")
def semi_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return joins.semi(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), e, "c_custkey")


@query("anti_join", "J7", "select c_custkey, c_name from customer where c_custkey not in (select user_id from events)")
def anti_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return joins.anti(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), e, "c_custkey")


@query("group_overlap", "J8", _V + """
select count(*) as n from visits where rater = 'Parent' and subject in (select subject from visits where rater = 'Teacher')""")
def group_overlap(spark, sf_dir):
    v = visits(spark, sf_dir)
    return joins.overlap_count(v.where("rater = 'Parent'"), v.where("rater = 'Teacher'"), "subject")


# Pieces of a part name and the outcome each one stands for, in matching order.
_RULES = [("red", "inattention"), ("blue", "hyperactivity"), ("bolt", "oppositional")]


@query("fill_result_cells", "J9 M11", """
with t as (select p_partkey, p_name as measure, p_type as rater, cast(null as double) as replicated_f,
  case when p_partkey % 2 = 0 then 0.5 end as replicated_p,
  case when contains(p_name, 'red') then 'inattention' when contains(p_name, 'blue') then 'hyperactivity'
    when contains(p_name, 'bolt') then 'oppositional' end as outcome from part),
v as (select case c_mktsegment when 'BUILDING' then 'inattention' when 'MACHINERY' then 'hyperactivity' else 'oppositional' end as outcome,
  'SMALL' as rater, max(c_acctbal) as f_value, min(c_acctbal) as p_value from customer
  where c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') group by 1)
select p_partkey, t.rater, t.outcome, coalesce(f_value, replicated_f) as replicated_f, coalesce(p_value, replicated_p) as replicated_p
from t left join v on v.outcome = t.outcome and v.rater = t.rater""")
def fill_result_cells(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("measure"), F.col("p_type").alias("rater"), F.lit(None).cast("double").alias("replicated_f"),
        F.when(F.col("p_partkey") % 2 == 0, 0.5).alias("replicated_p"))
    outcome = F.when(F.col("c_mktsegment") == "BUILDING", "inattention").when(F.col("c_mktsegment") == "MACHINERY", "hyperactivity") \
        .otherwise("oppositional")
    v = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")) \
        .groupBy(outcome.alias("outcome"), F.lit("SMALL").alias("rater")) \
        .agg(F.max("c_acctbal").alias("replicated_f"), F.min("c_acctbal").alias("replicated_p"))
    out = joins.fill_cells(t, _RULES, v, "measure", "rater", ["outcome", "rater"], ["replicated_f", "replicated_p"])
    return out.select("p_partkey", "rater", "outcome", "replicated_f", "replicated_p")


@query("rater_pairs", "J10 W3", _V + """, f as (select subject, rater, arg_min(score, visit_id) filter (score is not null) as score,
  min(visit_id) filter (score is not null) as visit_id from visits group by subject, rater)
select p.subject, p.score as score_a, t.score as score_b from f p join f t on p.subject = t.subject
where p.rater = 'Parent' and t.rater = 'Teacher' and p.score is not null and t.score is not null""")
def rater_pairs(spark, sf_dir):
    v = visits(spark, sf_dir).where("score is not null")
    return joins.pair_raters(v, "rater", "Parent", "Teacher", "subject", ["score"], "visit_id")


@query("source_reconciliation", "J11 P25", """
with a as (select o_custkey as subject, min(o_orderpriority) as p from orders where o_orderkey % 2 = 0 group by 1),
b as (select o_custkey as subject, min(o_orderpriority) as p from orders where o_orderkey % 2 = 1 group by 1)
select subject, a.p as p_a, b.p as p_b, a.p is not distinct from b.p as agrees from a full join b using (subject)""")
def source_reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "subject")
    a, b = (o.where(F.col("o_orderkey") % 2 == i).groupBy("subject").agg(F.min("o_orderpriority").alias("p")) for i in range(2))
    return joins.reconcile(a, b, "subject", "p")


@query("row_union", "J12", """
select s_suppkey as id, s_acctbal as balance, null as segment from supplier
union all select c_custkey, c_acctbal, c_mktsegment from customer""")
def row_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return joins.union_all([s, c])


@query("column_zip", "J13", """
select e.label, e.n, e.m, t.total from (select label, count(*) as n, max(vec_id) as m from embeddings group by label) e
join (select label, cast(sum(vec_id) as bigint) as total from embeddings group by label) t using (label)""")
def column_zip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("m"))
    return joins.zip_cols(a, e.groupBy("label").agg(F.sum("vec_id").alias("total")), "label")


@query("distinct_pairs", "J14", _V + "select distinct arm, site, rater from visits")
def distinct_pairs(spark, sf_dir):
    return joins.distinct_values(visits(spark, sf_dir), ["arm", "site", "rater"])


@query("set_difference", "J15", "select c_custkey as key from customer except select o_custkey from orders where o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return joins.except_rows(a, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")))


@query("set_intersection", "J16", "select c_custkey as key from customer intersect select user_id from events")
def set_intersection(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return joins.intersect_rows(a, table(spark, sf_dir, "events").select(F.col("user_id").alias("key")))


# Options of an experiment grid.
_OPTIONS = {"rater_out": ["m", "f", "t"], "model": ["forest", "boosted"], "threshold": [50, 20]}


@query("option_grid", "J17 L24 F19", """
select distinct arm as outcome, r.x as rater_out, m.x as model, cast(t.x as int) as threshold, concat(arm, ' ~ ', m.x, ' * ', r.x) as formula
from (with """ + VISITS_SQL + """ select distinct arm from visits) v, (values ('m'), ('f'), ('t')) r(x), (values ('forest'), ('boosted')) m(x), (values (50), (20)) t(x)""")
def option_grid(spark, sf_dir):
    from armwave.functions.text import formula_text

    outcomes = subjects(spark, sf_dir).join(visits(spark, sf_dir).select("subject"), "subject", "left_semi").select(F.col("arm").alias("outcome")).distinct()
    return joins.grid(outcomes, _OPTIONS).withColumn("formula", formula_text("outcome", "model", "rater_out"))


@query("arm_counts_joined", "J1 G4", _V + f"select arm, count(*) as n, {sfix('avg(score)')} as mean from visits group by arm")
def arm_counts_joined(spark, sf_dir):
    return visits(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("score")).alias("mean"))
