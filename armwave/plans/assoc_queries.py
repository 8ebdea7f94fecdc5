"""Checked queries: column audits, association and agreement statistics."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import assoc, audit
from armwave.plans.base import ITEMS_SQL, VISITS_SQL, items, table, visits
from armwave.plans.registry import query, sfix

_V = "with " + VISITS_SQL + " "
_I = "with " + ITEMS_SQL + " "
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _fixed_cols(df, *cols):
    return df.withColumns({c: fixed(c) for c in cols})


_AUDIT_SQL = """t as (select o_orderkey, o_orderstatus, cast(null as varchar) as emptyx, 'same' as constant,
  case when o_orderkey % 4 = 0 then o_totalprice end as sparse, o_totalprice as scorex, o_totalprice * 2 as scoret,
  o_totalprice as total, case when o_orderkey % 3 > 0 then o_totalprice end as total_raw, o_custkey as helper from orders)"""


def _audit_table(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("emptyx"), F.lit("same").alias("constant"),
        F.when(F.col("o_orderkey") % 4 == 0, price).alias("sparse"), price.alias("scorex"), (price * 2).alias("scoret"), price.alias("total"),
        F.when(F.col("o_orderkey") % 3 > 0, price).alias("total_raw"), F.col("o_custkey").alias("helper"))


_AUDIT_COLS = ["o_orderkey", "o_orderstatus", "emptyx", "constant", "sparse", "scorex", "scoret", "total", "total_raw", "helper"]


@query("column_profile", "A1", "with " + _AUDIT_SQL + " union all ".join(
    f" select '{c}' as \"column\", count({c}) as non_null, {sfix(f'100.0::double * (count(*) - count({c})) / count(*)')} as null_pct, count(distinct {c}) as \"distinct\", "
    f"{chr(39) + 'Order status' + chr(39) if c == 'o_orderstatus' else 'null'} as description from t" for c in _AUDIT_COLS))
def column_profile(spark, sf_dir):
    dictionary = spark.createDataFrame([("o_orderstatus", "Order status")], "column string, description string")
    return _fixed_cols(audit.profile(_audit_table(spark, sf_dir), dictionary), "null_pct")


@query("columns_with_values", "A2", "with " + _AUDIT_SQL + " select " + ", ".join(c for c in _AUDIT_COLS if c != "emptyx") + " from t")
def columns_with_values(spark, sf_dir):
    return audit.non_null_cols(_audit_table(spark, sf_dir))


@query("empty_columns_dropped", "A3", "with " + _AUDIT_SQL + " select " + ", ".join(c for c in _AUDIT_COLS if c != "emptyx") + " from t")
def empty_columns_dropped(spark, sf_dir):
    return audit.drop_empty(_audit_table(spark, sf_dir))


@query("constant_columns_dropped", "A4", "with " + _AUDIT_SQL + " select " + ", ".join(c for c in _AUDIT_COLS if c != "constant") + " from t")
def constant_columns_dropped(spark, sf_dir):
    return audit.drop_constant(_audit_table(spark, sf_dir), keep=["emptyx"])


@query("raw_twins_dropped", "A5", "with " + _AUDIT_SQL + " select " + ", ".join(c for c in _AUDIT_COLS if c not in ("total_raw", "helper")) + " from t")
def raw_twins_dropped(spark, sf_dir):
    return audit.drop_raw_twins(_audit_table(spark, sf_dir), add=["helper"], keep=["scorex"])


@query("sparse_columns_dropped", "A6", "with " + _AUDIT_SQL + " select " + ", ".join(c for c in _AUDIT_COLS if c not in ("emptyx", "sparse")) + " from t")
def sparse_columns_dropped(spark, sf_dir):
    return audit.drop_sparse(_audit_table(spark, sf_dir), 50)


@query("pruned_table", "A7 A3 A4 A5 A6", "with " + _AUDIT_SQL + " select o_orderkey, o_orderstatus, total, helper, scorex, scoret from t")
def pruned_table(spark, sf_dir):
    return audit.prune(_audit_table(spark, sf_dir), keep=["scorex"])


# Declared types of the audited table.
_TYPES = {"o_orderkey": "Integer", "o_orderstatus": "String", "sparse": "Float", "total": "Float", "scorex": "Float", "scoret": "Float", "constant": "String"}


@query("pre_audit", "A8 P16 P14", "with " + _AUDIT_SQL + " select nullif(o_orderkey, 9) as o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus, scorex, scoret, total from t")
def pre_audit(spark, sf_dir):
    return audit.pre_audit(_audit_table(spark, sf_dir), _TYPES, {"Integer": "bigint", "Float": "double", "String": "string"},
                           [9, "P"], keep=["scorex"], pct=50)


@query("leftover_codes", "P17", """
select '7' as code, 'p_size' as "column" where exists (select 1 from part where p_size = 7)
union all select '7', 'p_partkey' where exists (select 1 from part where p_partkey = 7)
union all select 'SMALL', 'p_type' where exists (select 1 from part where p_type = 'SMALL')""")
def leftover_codes(spark, sf_dir):
    return audit.verify_audit(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand"), [7, "SMALL", "absent"])


@query("dictionary_search", "A9", "select item_id, text from benchmark where regexp_matches(text, 'thr|ÉA|zz', 'i')")
def dictionary_search(spark, sf_dir):
    return audit.search_dictionary(table(spark, sf_dir, "benchmark"), ["thr", "(?u)ÉA", "zz"], "text")


_ASSOC_COLS = ["l_linenumber", "l_returnflag", "l_linestatus", "l_tax", "l_discount"]


def _cramer_sql():
    parts = []
    for i, a in enumerate(_ASSOC_COLS):
        for b in _ASSOC_COLS[i + 1:]:
            parts.append(f"""select '{a}' as "left", '{b}' as "right", sqrt(greatest((sum(n * n / (r * c)) - 1) / (least(any_value(na), any_value(nb)) - 1), 0)) as v from (
  select n, sum(n) over (partition by a) as r, sum(n) over (partition by b) as c, (select count(distinct {a}) from lineitem) as na, (select count(distinct {b}) from lineitem) as nb
  from (select {a} as a, {b} as b, cast(count(*) as double) as n from lineitem group by 1, 2))""")
    return f"select \"left\", \"right\", {sfix('v')} as cramer_v from (" + " union all ".join(parts) + ") order by v desc limit 4"


@query("top_associations", "A10", _cramer_sql())
def top_associations(spark, sf_dir):
    return _fixed_cols(audit.top_assoc(table(spark, sf_dir, "lineitem"), _ASSOC_COLS, 4), "cramer_v")


@query("key_overlaps", "A11", """
with a as (select distinct o_custkey k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey k from orders where o_orderstatus = 'P'),
c as (select distinct user_id k from events)
select 'F & P' as pair, count(*) as n from a join b using (k) union all select 'F & users', count(*) from a join c using (k)
union all select 'P & users', count(*) from b join c using (k) union all select 'all', count(*) from a join b using (k) join c using (k)""")
def key_overlaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return audit.overlap({"F": o.where("o_orderstatus = 'F'"), "P": o.where("o_orderstatus = 'P'"), "users": users}, "k")


@query("unassigned_variables", "A13", "select c_name as name from customer where c_nationkey <= 3")
def unassigned_variables(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_nationkey")
    return audit.check_types(names.select("name"), names.where("c_nationkey > 3"))


@query("rater_feature_counts", "A14", """
with n as (select concat(p_name, '_', substr('mftcx', cast(p_size % 5 + 1 as int), 1)) as name from part)
select regexp_extract(name, '_([mfct])$', 1) as rater, count(*) as n from n where regexp_matches(name, '_[mfct]$') group by 1""")
def rater_feature_counts(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit("_"), F.substr(F.lit("mftcx"), F.col("p_size") % 5 + 1, F.lit(1)))
    return audit.rater_counts(table(spark, sf_dir, "part").select(name.alias("name")))


@query("rater_combinations", "A14", """
with c as (select p_brand, count(*) filter (p_size % 7 = 0) as m, count(*) filter (p_size % 11 = 0) as f, count(*) filter (p_size % 13 = 0) as t from part group by p_brand)
select p_brand, case when m > 0 and t > 0 then 'all' when m > 0 and f = 0 then 'm' when t > 0 and f = 0 then 't' when m = 0 and t = 0 then 'f' else 'ambiguous' end as combo from c""")
def rater_combinations(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_if(F.col("p_size") % 7 == 0).alias("m"), F.count_if(F.col("p_size") % 11 == 0).alias("f"), F.count_if(F.col("p_size") % 13 == 0).alias("t"))
    return c.select("p_brand", audit.rater_combo().alias("combo"))


@query("score_correlations", "C1", _I + " union all ".join(
    f"select '{c}' as variable, {sfix(f'corr(l_quantity, {c})')} as r, count({c}) as n from items" for c in _COLS[1:]))
def score_correlations(spark, sf_dir):
    return _fixed_cols(assoc.corr_with(items(spark, sf_dir), "l_quantity", _COLS[1:]), "r")


_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]


@query("correlation_matrix", "C2", _I + " union all ".join(
    f"select '{a}' as \"left\", '{b}' as \"right\", count(*) filter ({a} is not null and {b} is not null) as n, {sfix(f'corr({a}, {b})')} as weight from items" for a, b in _PAIRS))
def correlation_matrix(spark, sf_dir):
    return _fixed_cols(assoc.corr_matrix(items(spark, sf_dir), _COLS).drop("i", "j"), "weight")


_IMPUTED_SQL = ", imputed as (select " + ", ".join(f"coalesce({c}, (select avg({c}) from items)) as {c}" for c in _COLS) + " from items)"


@query("cosine_matrix", "C3", "with " + ITEMS_SQL + _IMPUTED_SQL + " union all ".join(
    f" select '{a}' as \"left\", '{b}' as \"right\", {sfix(f'sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b}))')} as weight from imputed" for a, b in _PAIRS))
def cosine_matrix(spark, sf_dir):
    return _fixed_cols(assoc.cosine_matrix(items(spark, sf_dir), _COLS).drop("i", "j"), "weight")


@query("item_graph", "C4", "with " + ITEMS_SQL + _IMPUTED_SQL + ", m as (" + " union all ".join(
    f" select '{a}' as \"left\", '{b}' as \"right\", {sfix(f'sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b}))')} as weight from imputed" for a, b in _PAIRS)
       + ") select \"left\", \"right\", weight, 'blue' as colour from m where abs(weight) > 0.7")
def item_graph(spark, sf_dir):
    m = _fixed_cols(assoc.cosine_matrix(items(spark, sf_dir), _COLS), "weight")
    return assoc.similarity_graph(m, 0.7)


@query("item_graph_nodes", "C4", "with " + ITEMS_SQL + ", m as (" + " union all ".join(
    f" select '{a}' as a, '{b}' as b, corr({a}, {b}) as w from items" for a, b in _PAIRS) + """), e as (select * from m where abs(w) > 0.005)
select n.node, count(e.a) as degree from (values """ + ", ".join(f"('{c}')" for c in _COLS) + ") n(node) left join e on n.node in (e.a, e.b) group by n.node")
def item_graph_nodes(spark, sf_dir):
    m = assoc.corr_matrix(items(spark, sf_dir), _COLS)
    return assoc.graph_nodes(m, assoc.similarity_graph(m, 0.005, signed=True), _COLS)


_WIDE_SQL = ", wide as (select subject, " + ", ".join(
    f"avg(score) filter (rater = '{r}' and site = {s}) as s{s}_{r[0].lower()}" for s in (1, 2, 3) for r in ("Parent", "Teacher")) + " from visits group by subject)"


@query("same_item_two_raters", "C5", _V + _WIDE_SQL + " union all ".join(
    f" select 's{s}' as item, {sfix(f'corr(s{s}_p, s{s}_t)')} as r from wide" for s in (1, 2, 3)))
def same_item_two_raters(spark, sf_dir):
    wide = visits(spark, sf_dir).groupBy("subject").agg(*[
        F.avg(F.when((F.col("rater") == r) & (F.col("site") == s), F.col("score"))).alias(f"s{s}_{r[0].lower()}")
        for s in (1, 2, 3) for r in ("Parent", "Teacher")])
    return _fixed_cols(assoc.rater_item_corr(wide), "r")


_PAIR_SQL = """, f as (select subject, rater, arg_min(score, visit_id) filter (score is not null) as score, arg_min(day, visit_id) filter (score is not null) as day from visits group by 1, 2),
p as (select a.score as score_a, b.score as score_b, a.day as day_a, b.day as day_b from f a join f b using (subject)
  where a.rater = 'Parent' and b.rater = 'Teacher' and a.score is not null and b.score is not null)"""


@query("paired_rater_items", "C6 J10", _V + _PAIR_SQL + " union all ".join(
    f" select '{i}' as item, {sfix(f'corr({i}_a, {i}_b)')} as r, {sfix(f'avg({i}_a) - avg({i}_b)')} as mean_diff from p" for i in ("score", "day")))
def paired_rater_items(spark, sf_dir):
    from armwave.operators.joins import pair_raters

    pairs = pair_raters(visits(spark, sf_dir).where("score is not null"), "rater", "Parent", "Teacher", "subject", ["score", "day"], "visit_id")
    return _fixed_cols(assoc.paired_item_corr(pairs, ["score", "day"]), "r", "mean_diff")


@query("intraclass_correlation", "C7", _V + f""", w as (select subject, avg(score) filter (rater = 'Parent') as x0, avg(score) filter (rater = 'Teacher') as x1 from visits group by subject),
c as (select subject, x0, x1, (x0 + x1) / 2 as m from w where x0 is not null and x1 is not null),
s as (select count(*) as n, var_pop(m) * count(*) * 2 as sst, sum((x0 - m) ** 2 + (x1 - m) ** 2) as ssw, (avg(x0) - avg(m)) ** 2 + (avg(x1) - avg(m)) ** 2 as r from c),
q as (select n, sst / (n - 1) as ms_target, (ssw - n * r) / (n - 1) as ms_error from s)
select n, 2 as k, {sfix('ms_target')} as ms_target, {sfix('ms_error')} as ms_error, {sfix('(ms_target - ms_error) / (ms_target + ms_error)')} as icc3 from q""")
def intraclass_correlation(spark, sf_dir):
    m = assoc.icc_mean_squares(visits(spark, sf_dir), "subject", "rater", "score", ["Parent", "Teacher"])
    return _fixed_cols(m, "ms_target", "ms_error", "icc3")


@query("score_regression", "C8", _V + f"""
select arm, {sfix('regr_slope(score, day)', 9)} as slope, {sfix('regr_intercept(score, day)')} as intercept, {sfix('corr(score, day)')} as r,
  cast(regr_count(score, day) as bigint) as n, {sfix('sqrt((1 - corr(score, day) ** 2) * regr_syy(score, day) / regr_sxx(score, day) / (regr_count(score, day) - 2))', 9)} as slope_se from visits group by arm""")
def score_regression(spark, sf_dir):
    r = assoc.linreg(visits(spark, sf_dir), "day", "score", ["arm"])
    return r.withColumns({"slope": fixed("slope", 9), "slope_se": fixed("slope_se", 9), "intercept": fixed("intercept"), "r": fixed("r")})


@query("summary_t_tests", "C9", _V + f""", s as (select arm, avg(score) as m, stddev_samp(score) as sd, count(score) as n from visits group by arm)
select a.arm as arm_a, b.arm as arm_b, {sfix('(a.m - b.m) / sqrt(((a.n - 1) * a.sd ** 2 + (b.n - 1) * b.sd ** 2) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))')} as t, a.n + b.n - 2 as free
from s a join s b on a.arm < b.arm""")
def summary_t_tests(spark, sf_dir):
    s = visits(spark, sf_dir).groupBy("arm").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n"))
    a, b = (s.select(*[F.col(c).alias(f"{c}_{x}") for c in s.columns]) for x in "ab")
    pairs = spark.createDataFrame(list(itertools.combinations("ACLMP", 2)), "arm_a string, arm_b string")
    t, free = assoc.t_test_summary(*[F.col(f"{c}_{x}") for x in "ab" for c in ("m", "sd", "n")])
    return pairs.join(a, "arm_a").join(b, "arm_b").select("arm_a", "arm_b", fixed(t).alias("t"), free.alias("free"))


@query("signed_rank_test", "C10 W8", _V + _PAIR_SQL + """, d as (select score_a - score_b as d from p where score_a <> score_b),
r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as k, count(*) over (partition by abs(d)) as t from d)
select count(*) as n, coalesce(sum(k) filter (d > 0), 0) as w_plus, coalesce(sum(k) filter (d < 0), 0) as w_minus,
  least(coalesce(sum(k) filter (d > 0), 0), coalesce(sum(k) filter (d < 0), 0)) as w, sum(cast(t as double) * t - 1) as tie_sum from r""")
def signed_rank_test(spark, sf_dir):
    from armwave.operators.joins import pair_raters

    pairs = pair_raters(visits(spark, sf_dir).where("score is not null"), "rater", "Parent", "Teacher", "subject", ["score"], "visit_id")
    return assoc.wilcoxon(pairs, "score_a", "score_b")


@query("variance_inflation", "C11", None)
def variance_inflation(spark, sf_dir):
    li = items(spark, sf_dir).withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    found = assoc.vif(li, ["l_quantity", "l_extendedprice", "l_discount", "gross"])
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "variable string, vif double")


@query("variance_inflation_by_determinant", "C11", "with " + ITEMS_SQL + """,
r as (select corr(l_quantity, l_extendedprice) as ab, corr(l_quantity, l_quantity + l_linenumber) as ac, corr(l_extendedprice, l_quantity + l_linenumber) as bc from items),
d as (select *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc as det from r)""" + f"""
select 'l_quantity' as variable, {sfix('(1 - bc * bc) / det', 4)} as vif from d union all select 'l_extendedprice', {sfix('(1 - ac * ac) / det', 4)} from d
union all select 'moved', {sfix('(1 - ab * ab) / det', 4)} from d""")
def variance_inflation_by_determinant(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("moved", F.col("l_quantity") + F.col("l_linenumber"))
    found = assoc.vif(i, ["l_quantity", "l_extendedprice", "moved"])
    rows = spark.createDataFrame([(k, float(v)) for k, v in found.items()], "variable string, vif double")
    return rows.withColumn("vif", fixed("vif", 4))


@query("residual_table", "C12", "with " + ITEMS_SQL + """, b as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from items)
select l_orderkey, l_linenumber, l_partkey, """ + sfix("l_extendedprice - (i + s * l_quantity)", 3) + " as residual from items, b")
def residual_table(spark, sf_dir):
    i = items(spark, sf_dir)
    b = assoc.linreg(i, "l_quantity", "l_extendedprice").first()
    predicted = i.withColumn("yhat", F.lit(b["intercept"]) + F.lit(b["slope"]) * F.col("l_quantity"))
    return assoc.residuals(predicted, "l_extendedprice", "yhat").select("l_orderkey", "l_linenumber", "l_partkey", fixed("residual", 3).alias("residual"))


_SELECT_SQL = ", w as (select l_quantity, l_quantity * 2 + l_linenumber as twice, l_extendedprice, l_extendedprice * (1 + l_tax) as gross, l_tax from items)"
_SELECT_COLS = ["l_quantity", "twice", "l_extendedprice", "gross", "l_tax"]


@query("correlated_columns", "C13", "with " + ITEMS_SQL + _SELECT_SQL + " select distinct dropped from (" + " union all ".join(
    f"select '{b}' as dropped, corr({a}, {b}) as r from w" for i, a in enumerate(_SELECT_COLS) for b in _SELECT_COLS[i + 1:]) + ") where abs(r) > 0.8")
def correlated_columns(spark, sf_dir):
    w = items(spark, sf_dir).select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("twice"), "l_extendedprice",
                                    (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"), "l_tax")
    return assoc.correlated_columns(w, _SELECT_COLS, 0.8)
