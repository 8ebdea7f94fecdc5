"""Checked queries: filters, flags, casts, missing codes, column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.operators import columns, filters
from armwave.plans.base import FLAGS_SQL, ITEMS_SQL, VISITS_SQL, items, table, user_flags, visits
from armwave.plans.registry import query

_V = "with " + VISITS_SQL + " "
_F = "with " + FLAGS_SQL + " "
_I = "with " + ITEMS_SQL + " "


@query("mask_comparisons", "P1", _V + """
select 'eq' as op, visit_id from visits where day = 0 union all select 'gt', visit_id from visits where day > 500
union all select 'get', visit_id from visits where day >= 500 union all select 'lt', visit_id from visits where day < 46
union all select 'let', visit_id from visits where day <= 46""")
def mask_comparisons(spark, sf_dir):
    v = visits(spark, sf_dir)
    out = None
    for op, value in (("eq", 0), ("gt", 500), ("get", 500), ("lt", 46), ("let", 46)):
        part = filters.mask(v, "day", op, value).select(F.lit(op).alias("op"), "visit_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("mask_ranges", "P2", _V + """
select 'delta' as op, visit_id from visits where day between 154 and 182
union all select 'pair', visit_id from visits where day between 46 and 168
union all select 'open', visit_id from visits where day > 46 and day < 168""")
def mask_ranges(spark, sf_dir):
    v = visits(spark, sf_dir)
    parts = [("delta", filters.mask(v, "day", "range", 168, 14)), ("pair", filters.mask(v, "day", "range", (46, 168))),
             ("open", filters.mask(v, "day", "open", (46, 168)))]
    parts = [df.select(F.lit(op).alias("op"), "visit_id") for op, df in parts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("expression_filter", "P3", _V + "select visit_id, subject from visits where arm = 'M' and rater = 'Teacher'")
def expression_filter(spark, sf_dir):
    return visits(spark, sf_dir).filter("arm = 'M' and rater = 'Teacher'").select("visit_id", "subject")


@query("cohort_subset", "P4 J6", """
select event_id, user_id, value from events where event_type = 'purchase' and (user_id % 2 = 0)
  and user_id in (select c_custkey from customer where c_mktsegment <> 'FURNITURE')""")
def cohort_subset(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("completed", F.when(F.col("user_id") % 2 == 0, 1).otherwise(0))
    ids = table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("user_id"))
    return filters.cohort_subset(e, "event_type", "purchase", "completed", ids, "user_id").select("event_id", "user_id", "value")


@query("arm_exclusion", "P5", _V + ", w as (select visit_id, case when subject % 9 <> 0 then arm end as arm from visits) "
       "select visit_id, arm from w where arm is null or arm not in ('L')")
def arm_exclusion(spark, sf_dir):
    v = visits(spark, sf_dir).select("visit_id", F.when(F.col("subject") % 9 != 0, F.col("arm")).alias("arm"))
    return filters.exclude(v, "arm", ["L"])


@query("code_membership", "P6", "select p_partkey, p_size in (1, 5, 9, 49) as listed from part")
def code_membership(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", filters.in_codes("p_size", [1, 5, 9, 49]).alias("listed"))


@query("drop_null_rows", "P7", _F + "select * from flags where click is not null and view is not null and purchase is not null "
       "and signup is not null and error is not null")
def drop_null_rows(spark, sf_dir):
    return filters.drop_null(user_flags(spark, sf_dir))


@query("complete_cases", "P8", _I + "select l_orderkey, l_linenumber, l_discount, l_tax from items where l_discount is not null and l_tax is not null")
def complete_cases(spark, sf_dir):
    i = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return filters.complete_cases(i, ["l_discount", "l_tax", "not_there"])


@query("select_by_name", "P9", "select o_orderkey, o_orderdate::date as o_orderdate, o_orderpriority from orders")
def select_by_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return columns.select_cols(o, startswith="o_order", contains="r", endswith=None, positions=slice(3, None), always=["o_orderkey"])


@query("rename_columns", "P10", "select c_custkey, c_name as c_name_out, c_acctbal as c_acctbal_out from customer")
def rename_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("C_NAME"), F.col("c_acctbal").alias("C_AcctBal"))
    return columns.rename_suffix(columns.lower_cols(c), "_out", keep=["c_custkey"])


@query("move_columns", "P11", "select n_regionkey, n_name, n_nationkey from nation")
def move_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return columns.reorder(columns.move_column(n, "n_nationkey", 2), ["n_regionkey"])


@query("base_casts", "P12", """
select cast(o_custkey as varchar) as src_subject_id, o_orderstatus as sex, cast(o_orderkey % 6 as varchar) as site,
  cast(o_orderkey % 20 as int) as interview_age, cast(o_orderkey % 400 as int) as days_baseline,
  case when o_orderkey % 13 <> 0 then cast(o_orderdate as date) end as interview_date from orders""")
def base_casts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_custkey").alias("src_subject_id"), F.col("o_orderstatus").alias("sex"), (F.col("o_orderkey") % 6).alias("site"),
        (F.col("o_orderkey") % 20).cast("string").alias("interview_age"), (F.col("o_orderkey") % 400).cast("string").alias("days_baseline"),
        F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("unknown").alias("interview_date"))
    return columns.cast_base(raw)


@query("casts_by_map", "P13", """
select l_orderkey, cast(l_quantity as int) as l_quantity, cast(l_linenumber as varchar) as l_linenumber from lineitem""")
def casts_by_map(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    return columns.cast_by_map(li, {"l_quantity": "int", "l_linenumber": "string", "absent": "double"})


# Declared types of a small data dictionary, and the type each name stands for.
_DICTIONARY = [("p_partkey", "Integer"), ("p_size", "Float"), ("p_brand", "String"), ("p_retailprice", "String")]
_TYPE_NAMES = {"Integer": "bigint", "Float": "double", "String": "string"}


@query("casts_by_dictionary", "P14", """
select p_partkey, cast(p_size as double) as p_size, p_brand, p_name from part""")
def casts_by_dictionary(spark, sf_dir):
    part = table(spark, sf_dir, "part").drop("p_retailprice")
    dictionary = spark.createDataFrame(_DICTIONARY, "ElementName string, DataType string")
    declared = columns.dictionary_map(dictionary, part.columns)
    return columns.cast_by_dictionary(part, declared, _TYPE_NAMES, keep=["p_name"])


@query("lenient_numbers", "P15", """
select o_orderkey, try_cast(case when o_orderkey % 5 = 0 then o_orderstatus else cast(o_orderkey as varchar) end as double) as value
from orders""")
def lenient_numbers(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderkey").cast("string"))
    return columns.to_number(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("value")), ["value"])


@query("missing_codes", "P16", """
select l_orderkey, l_linenumber, nullif(nullif(l_quantity, 9), 5) as l_quantity, nullif(cast(l_partkey as varchar), '9') as l_partkey,
  nullif(l_linestatus, 'F') as l_linestatus from lineitem""")
def missing_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").cast("string").alias("l_partkey"), "l_linestatus")
    return columns.null_codes(li, [9, 5, "F"], skip={"l_partkey": [5]}, cols=["l_quantity", "l_partkey", "l_linestatus"])


@query("rater_collapse", "P18", """
select o_orderkey, case when starts_with(o_orderpriority, '1') then '1' when starts_with(o_orderpriority, '4-NOT') then '4-NOT'
  else o_orderpriority end as rater from orders""")
def rater_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("rater"))
    return filters.collapse_rater(o, "rater", ["1", "4-NOT"])


@query("code_groups", "P19", """
select s_suppkey, case when s_nationkey in (1, 2, 3) then 1 when s_nationkey in (4, 5) then 2 else 0 end as role from supplier""")
def code_groups(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", filters.code_group("s_nationkey", [1, 2, 3], [4, 5]).alias("role"))


# A few relationship codes and labels.
_RELATIONS = {1: "Biological mother", 2: "Biological father", 3: "Stepmother", 4: "Stepfather", 20: "Teacher"}


@query("code_labels", "P20", "select c.c_custkey, m.label from customer c left join (values " + ", ".join(
    f"({k}, '{v}')" for k, v in _RELATIONS.items()) + ") m(code, label) on m.code = c.c_nationkey")
def code_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", filters.decode("c_nationkey", _RELATIONS).alias("label"))


_ITEMS = ("click", "view", "purchase", "signup", "error")


@query("any_item_flag", "P21", _F + f"""
select subject, case when {' or '.join(f'coalesce({k} = 1, false)' for k in _ITEMS)} then 1
  when {' and '.join(f'coalesce({k} = 0, false)' for k in _ITEMS)} then 0 end as anxiety from flags""")
def any_item_flag(spark, sf_dir):
    return user_flags(spark, sf_dir).select("subject", filters.any_flag(_ITEMS).alias("anxiety"))


@query("moderator_split", "P22", _V + """
select visit_id, day, case when site in (1, 2) then 'no' else 'yes' end as mod_group from visits
where site in (1, 2, 3, 4) and day between 0 and 450""")
def moderator_split(spark, sf_dir):
    v = filters.split_moderator(visits(spark, sf_dir), "site", [1, 2], [3, 4], "day", 0, 450)
    return v.select("visit_id", "day", "mod_group")


@query("fill_constant", "P23", _V + "select visit_id, coalesce(score, -1.0) as score from visits")
def fill_constant(spark, sf_dir):
    return columns.fill_const(visits(spark, sf_dir).select("visit_id", "score"), -1.0, ["score"])


# Pieces of a part name in matching order, with their labels.
_LABELS = [("red", "R"), ("ring", "G"), ("blue", "B"), ("bolt", "T")]


@query("label_by_contains", "P24", "select p_partkey, case " + " ".join(
    f"when contains(p_name, '{k}') then '{v}'" for k, v in _LABELS) + " else p_type end as label from part")
def label_by_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", filters.label_by_contains("p_name", _LABELS, "p_type").alias("label"))


@query("equal_columns", "P25", _I + "select l_orderkey, l_linenumber, l_discount is not distinct from l_tax as same from items")
def equal_columns(spark, sf_dir):
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", filters.equal_flag("l_discount", "l_tax").alias("same"))


@query("drop_columns", "P26", "select s_suppkey, s_acctbal from supplier")
def drop_columns(spark, sf_dir):
    return columns.drop_cols(table(spark, sf_dir, "supplier"), ["s_name", "s_nationkey", "not_there"])
