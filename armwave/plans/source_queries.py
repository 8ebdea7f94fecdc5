"""Checked queries: sources, stores and catalog searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import ordering
from armwave.plans.base import VISITS_SQL, table, visits
from armwave.plans.registry import query, sfix
from armwave.session import scratch_path, side_by_side
from armwave.sources import stores, tables

_V = "with " + VISITS_SQL + " "

# Description texts of the written questionnaire file.
_DESCRIPTIONS = {
    "src_subject_id": tables.DESCRIPTION_ID,
    "interview_date": "Date of interview",
    "days_baseline": "Days since baseline",
    "score": "Total score",
}


def _write_questionnaire(spark, sf_dir) -> str:
    """Visits as a tab-separated questionnaire file with a description record and repeated rows."""
    v = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("src_subject_id"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("interview_date"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 600).cast("string")).alias("days_baseline"),
        F.col("o_orderstatus").alias("score"))
    described = spark.createDataFrame([tuple(_DESCRIPTIONS.values())], v.schema)
    path = scratch_path(spark, "questionnaire")
    described.unionByName(v).write.option("header", True).option("sep", "\t").csv(path)
    return path


@query("questionnaire_read", "S1", """
select distinct cast(o_custkey as varchar) as src_subject_id, cast(o_orderdate as date) as interview_date,
  cast(o_orderkey % 600 as varchar) as days_baseline, o_orderstatus as score
from orders where o_orderkey % 11 <> 0""")
def questionnaire_read(spark, sf_dir):
    path = _write_questionnaire(spark, sf_dir)
    return tables.read_questionnaire(spark, path, ["src_subject_id", "interview_date", "days_baseline", "score"], described="marked")


_COUNTED = {"src_subject_id": "o_custkey", "interview_date": "o_orderdate", "days_baseline": "case when o_orderkey % 11 <> 0 then 1 end", "score": "o_orderstatus"}


@query("dictionary_split", "S2", "select d.*, coalesce(n.n, 0) as non_null from (values " + ", ".join(
    f"('{c}', '{d.replace(chr(39), chr(39) * 2)}')" for c, d in _DESCRIPTIONS.items()) + ") d(\"column\", description) left join (" + " union all ".join(
    f"select '{c}' as \"column\", count({e}) as n from orders" for c, e in _COUNTED.items()) + ") n using (\"column\")")
def dictionary_split(spark, sf_dir):
    """Descriptions of a written table, each with the number of values its column has in the data."""
    path = _write_questionnaire(spark, sf_dir)
    words = tables.read_dictionary(spark, path, described="marked")
    rows = tables.read_table(spark, path, sep="\t").where(F.col("src_subject_id") != tables.DESCRIPTION_ID)
    counts = rows.unpivot([], rows.columns, "column", "value").groupBy("column").agg(F.count("value").alias("non_null"))
    return words.join(counts, "column", "left").withColumn("non_null", F.coalesce("non_null", F.lit(0)))


@query("table_read", "S3", "select cast(p_partkey as varchar) as p_partkey, p_name, p_brand from part")
def table_read(spark, sf_dir):
    path = scratch_path(spark, "table")
    part = table(spark, sf_dir, "part").select(
        F.monotonically_increasing_id().alias("Unnamed: 0"), "p_partkey", "p_name", "p_brand")
    part.write.option("header", True).csv(path)
    return tables.read_table(spark, path)


@query("folder_read", "S4 J12", """
select 'customer' as "table", cast(c_custkey as varchar) as id, c_mktsegment as segment, cast(null as varchar) as brand from customer
union all select 'part', cast(p_partkey as varchar), null, p_brand from part""")
def folder_read(spark, sf_dir):
    folder = scratch_path(spark, "folder")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")) \
        .write.option("header", True).csv(f"{folder}/a")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")) \
        .write.option("header", True).csv(f"{folder}/b")
    first = tables.read_table(spark, f"{folder}/a").withColumn("table", F.lit("customer"))
    second = tables.read_table(spark, f"{folder}/b").withColumn("table", F.lit("part"))
    return first.unionByName(second, allowMissingColumns=True).select("table", "id", "segment", "brand")


@query("folder_scan", "S4", """
select 'part-' as "table", cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation""")
def folder_scan(spark, sf_dir):
    """Every file of a written folder read back with its name prefix (Spark names its files part-0...)."""
    folder = scratch_path(spark, "scan")
    table(spark, sf_dir, "nation").write.option("header", True).csv(folder)
    return tables.read_folder(spark, folder)


@query("json_field", "S5", """
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as integer), -1) as k,
  coalesce(json_extract_string(props, '$.absent'), 'none') as absent from events""")
def json_field(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = tables.read_json_field(e, "props", "$.k", -1, "k", "int")
    return tables.read_json_field(e, "props", "$.absent", "none", "absent").select("event_id", "k", "absent")


@query("id_list_cohort", "S7 J6", """
select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def id_list_cohort(spark, sf_dir):
    path = scratch_path(spark, "ids")
    stores.write_ids(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), path, "c_custkey")
    ids = stores.read_ids(spark, path)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(ids.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("partitioned_write", "S8", _V + """
select arm, rater, visit_id, subject, day from visits""")
def partitioned_write(spark, sf_dir):
    path = scratch_path(spark, "partitioned")
    stores.write_partitioned(visits(spark, sf_dir).select("arm", "rater", "visit_id", "subject", "day"), path, ["arm", "rater"])
    return spark.read.parquet(path).select("arm", "rater", "visit_id", "subject", "day")


@query("json_records", "S9", """
select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_regionkey = 1""")
def json_records(spark, sf_dir):
    path = scratch_path(spark, "json")
    n = table(spark, sf_dir, "nation")
    stores.write_json(n.select("n_nationkey", "n_name"), path, "overwrite")
    stores.write_json(n.where("n_regionkey = 1").select("n_nationkey", "n_name"), path, "append")
    return tables.read_records(spark, path, "n_nationkey int, n_name string")


_RESULT_SQL = _V + """, means as (select arm, rater, """ + sfix("avg(score)") + """ as mean from visits group by arm, rater),
stored as (select arm, case when rater = 'Parent' then rater end as rater, mean from means where arm <> 'L'),
fresh as (select arm, case when rater = 'Parent' then rater end as rater, mean from means where arm in ('A', 'L')) """


def _result_rows(spark, sf_dir):
    means = visits(spark, sf_dir).groupBy("arm", "rater").agg(fixed(F.avg("score")).alias("mean"))
    return means.withColumn("rater", F.when(F.col("rater") == "Parent", F.col("rater"))).select("arm", "rater", "mean")


@query("append_if_new", "S10", _RESULT_SQL + """
select * from stored union all select * from (select * from fresh except select * from stored)""")
def append_if_new(spark, sf_dir):
    rows = _result_rows(spark, sf_dir)
    return stores.append_if_new(rows.where("arm <> 'L'"), rows.where("arm in ('A', 'L')"))


@query("append_twice", "S10", _RESULT_SQL + "select * from stored union all select * from (select * from fresh except select * from stored)")
def append_twice(spark, sf_dir):
    path = scratch_path(spark, "results")
    rows = _result_rows(spark, sf_dir)
    for _ in range(2):
        stores.append_to_store(spark, path, rows.where("arm <> 'L'"))
        stores.append_to_store(spark, path, rows.where("arm in ('A', 'L')"))
    return spark.read.parquet(path)


@query("rows_of_several_writers", "S10", _RESULT_SQL + "select * from stored union select * from fresh")
def rows_of_several_writers(spark, sf_dir):
    """Four writers at the same time, two of them with the same rows."""
    path = scratch_path(spark, "commits")
    rows = _result_rows(spark, sf_dir)
    parts = [rows.where("arm <> 'L'"), rows.where("arm in ('A', 'L')")] * 2
    side_by_side(spark, [lambda new=new: stores.commit_rows(spark, path, new) for new in parts])
    return stores.read_committed(spark, path)


@query("drop_last_rows", "S11", """
select o_orderkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from orders order by o_orderkey desc limit 25)""")
def drop_last_rows(spark, sf_dir):
    return ordering.drop_last(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey")


@query("tables_with_column", "S12", """
select 'documents' as "table", count(text) as non_null from documents union all select 'benchmark', count(text) from benchmark
union all select 'conversations', count(text) from conversations""")
def tables_with_column(spark, sf_dir):
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
    return tables.find_tables_with_column({n: table(spark, sf_dir, n) for n in names}, "text")


@query("tables_by_keyword", "S13", "select * from (values ('orders.parquet'), ('lineitem.parquet')) t(file)")
def tables_by_keyword(spark, sf_dir):
    return tables.find_tables(spark, sf_dir, ["ORD", "item"]).select("file")


# Arm names used in tables.
_ARM_NAMES = [("M", "Medication Management"), ("P", "Behavioral Treatment"), ("C", "Combined Treatment"),
              ("A", "Assessment and Referral"), ("L", "Local Comparison Group")]


@query("literal_arm_names", "S15", _V + """
select t.arm, t.label, count(*) as n from (values """ + ", ".join(f"('{a}', '{b}')" for a, b in _ARM_NAMES) + """) t(arm, label)
join visits v on v.arm = t.arm group by t.arm, t.label""")
def literal_arm_names(spark, sf_dir):
    names = tables.literal_table(spark, _ARM_NAMES, "arm string, label string")
    counts = visits(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "arm").select("arm", "label", "n")


@query("score_store", "S14 C1", f"""
with r as (select 'quantity' as score, 'price' as variable, {sfix('corr(l_quantity, l_extendedprice)')} as r from lineitem
union all select 'quantity', 'tax', {sfix('corr(l_quantity, l_tax)')} from lineitem) select * from r""")
def score_store(spark, sf_dir):
    path = scratch_path(spark, "scores")
    li = table(spark, sf_dir, "lineitem")
    for variable, col in (("price", "l_extendedprice"), ("tax", "l_tax")):
        one = li.agg(fixed(F.corr("l_quantity", col)).alias("r"))
        stores.store_scores(one.select(F.lit("quantity").alias("score"), F.lit(variable).alias("variable"), "r"), path)
    return spark.read.parquet(path)
