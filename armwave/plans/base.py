"""Base tables of the checked queries: the given tables in the shape of a longitudinal cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Market segment to treatment arm; every other segment is the comparison arm L.
SEGMENT_ARMS = {"BUILDING": "M", "AUTOMOBILE": "P", "MACHINERY": "C", "HOUSEHOLD": "A"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject with arm and site."""
    c = table(spark, sf_dir, "customer")
    arm = F.lit("L")
    for segment, name in SEGMENT_ARMS.items():
        arm = F.when(F.col("c_mktsegment") == segment, name).otherwise(arm)
    return c.select(F.col("c_custkey").alias("subject"), arm.alias("arm"), (F.col("c_nationkey") % 6 + 1).alias("site"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit: id, subject, day since the subject's first visit, arm, site, rater, score.

    The first date is a small aggregate joined back, not a window, so that a subject with very
    many visits is not sent to one task.
    """
    o = table(spark, sf_dir, "orders")
    first = o.groupBy(F.col("o_custkey").alias("subject")).agg(F.min(F.to_date("o_orderdate")).alias("first_date"))
    rater = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Teacher").otherwise("Parent")
    score = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 100000)
    rows = o.select(
        F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("subject"),
        F.to_date("o_orderdate").alias("visit_date"), rater.alias("rater"), score.alias("score"))
    dims = subjects(spark, sf_dir).join(first, "subject")
    return rows.join(dims, "subject").select(
        "visit_id", "subject", F.date_diff("visit_date", "first_date").alias("day"), "arm", "site", "rater", "score")


VISITS_SQL = """visits as (
select o.o_orderkey as visit_id, o.o_custkey as subject,
  cast(date_diff('day', min(cast(o_orderdate as date)) over (partition by o_custkey), cast(o_orderdate as date)) as int) as day,
  case c.c_mktsegment when 'BUILDING' then 'M' when 'AUTOMOBILE' then 'P' when 'MACHINERY' then 'C'
    when 'HOUSEHOLD' then 'A' else 'L' end as arm,
  c.c_nationkey % 6 + 1 as site,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then 'Teacher' else 'Parent' end as rater,
  case when o_orderkey % 7 <> 0 then o_totalprice / 100000 end as score
from orders o join customer c on o.o_custkey = c.c_custkey)"""


def user_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis flags per user: 1 for many events of a type, 0 for a few, null for none."""
    e = table(spark, sf_dir, "events")
    kinds = ("click", "view", "purchase", "signup", "error")
    counts = e.groupBy(F.col("user_id").alias("subject")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    return counts.select("subject", *[
        F.when(F.col(k) > 16, 1).when(F.col(k) > 8, 0).alias(k) for k in kinds])


FLAGS_SQL = """flags as (
select user_id as subject, """ + ", ".join(
    f"case when count(*) filter (event_type = '{k}') > 16 then 1 when count(*) filter (event_type = '{k}') > 8 then 0 end as {k}"
    for k in ("click", "view", "purchase", "signup", "error")) + " from events group by user_id)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide numeric items per line: quantity, price, discount and tax, with some missing cells."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("l_tax"))


ITEMS_SQL = """items as (
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  case when l_linenumber <> 3 then l_discount end as l_discount,
  case when l_partkey % 5 <> 0 then l_tax end as l_tax from lineitem)"""
