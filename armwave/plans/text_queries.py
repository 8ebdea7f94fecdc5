"""Checked queries: text and number functions, on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.functions import numbers, text
from armwave.functions.numbers import fixed
from armwave.plans.base import VISITS_SQL, table, visits
from armwave.plans.registry import query, sfix

_V = "with " + VISITS_SQL + " "


@query("split_at_occurrence", "F1", """
with p as (select doc_id, text, strpos(text, '.') as a, case when strpos(text, '.') > 0 then strpos(substr(text, strpos(text, '.') + 1), '.') else 0 end as b from documents)
select doc_id, length(case when a > 0 then substr(text, 1, a - 1) else text end) as head_1, md5(case when a > 0 then substr(text, a + 1) else '' end) as tail_1,
  length(case when b > 0 then substr(text, 1, a + b - 1) else text end) as head_2, md5(case when b > 0 then substr(text, a + b + 1) else '' end) as tail_2 from p""")
def split_at_occurrence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h1, t1 = text.split_on_occurrence("text", ".", 1)
    h2, t2 = text.split_on_occurrence("text", ".", 2)
    return d.select("doc_id", F.length(h1).cast("bigint").alias("head_1"), F.md5(t1).alias("tail_1"),
                    F.length(h2).cast("bigint").alias("head_2"), F.md5(t2).alias("tail_2"))


@query("measure_and_rater", "F2", "select o_orderkey, split_part(o_orderpriority, '-', 1) as measure, "
       "nullif(substr(o_orderpriority, strpos(o_orderpriority, '-') + 1), '') as rater from orders")
def measure_and_rater(spark, sf_dir):
    m, r = text.split_label("o_orderpriority", "-")
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("measure"), r.alias("rater"))


@query("name_parts", "F3", """
select p_partkey, case when len(x) >= 2 then x[-2] end as penult, x[-1] as last from (
  select p_partkey, string_split(concat(p_type, '_', replace(p_name, ' ', '_')), '_') as x from part)""")
def name_parts(spark, sf_dir):
    name = F.concat(F.col("p_type"), F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select("p_partkey", text.name_part(name, 2).alias("penult"), text.name_part(name, 1).alias("last"))


@query("published_cells", "F4", """
select p_partkey, case when p_size % 10 <> 0 then p_retailprice end as mean, case when p_size % 10 <> 0 then cast(p_size as double) end as sd,
  case when p_size % 10 <> 0 then p_partkey end as n from part""")
def published_cells(spark, sf_dir):
    cell = F.when(F.col("p_size") % 10 != 0, F.concat(F.col("p_retailprice").cast("string"), F.lit(" ("), F.col("p_size").cast("string"),
                                                      F.lit(") ["), F.col("p_partkey").cast("string"), F.lit("]"))).otherwise("...")
    m, s, n = text.parse_mean_sd_n(cell)
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("mean"), s.alias("sd"), n.alias("n"))


@query("p_value_texts", "F5", """
with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_tax = 0 then '<.001' when l_tax = 0.08 then 'ns' else cast(l_tax as varchar) end as p from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, try_cast(p as double) as p_value, case when contains(p, '<') then true else try_cast(p as double) < 0.05 end as significant from t""")
def p_value_texts(spark, sf_dir):
    p = F.when(F.col("l_tax") == 0, "<.001").when(F.col("l_tax") == 0.08, "ns").otherwise(F.col("l_tax").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.p_value_number(p).alias("p_value"),
                                                   text.p_significant(p).alias("significant"))


_DOSE_SQL = """case when l_linenumber = 1 then cast(l_quantity as int)::varchar when l_linenumber = 2 then concat(l_partkey, '-', l_suppkey)
  when l_linenumber = 3 then null when l_linenumber = 4 then concat(l_partkey, 'sr-', l_suppkey, '-', l_linenumber)
  when l_linenumber = 5 then concat(l_partkey, '-x', l_suppkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) else concat(l_partkey, ',', l_suppkey, ', ', l_linenumber, '/', l_suppkey) end"""


@query("dose_slots", "F6", f"""
with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace({_DOSE_SQL}, '[^\\d]x', '', 'g') as dose from lineitem),
s as (select *, string_split_regex(replace(dose, 'sr', ''), '\\D+') as p from d)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(regexp_matches(dose, '^(\\d+\\D+){{2,3}}\\d+'), false) as valid,
  coalesce(p[1], '0') as morning, coalesce(p[2], '0') as midday, coalesce(p[3], '0') as evening,
  case when len(p) > 4 then regexp_extract(replace(dose, 'sr', ''), '^(?:\\d+\\D+){{3}}(.*)$', 1) else coalesce(p[4], '0') end as night from s""")
def dose_slots(spark, sf_dir):
    c = {k: F.col(f"l_{k}").cast("string") for k in ("partkey", "suppkey", "linenumber")}
    dose = (
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast("int").cast("string"))
        .when(F.col("l_linenumber") == 2, F.concat(c["partkey"], F.lit("-"), c["suppkey"]))
        .when(F.col("l_linenumber") == 3, F.lit(None))
        .when(F.col("l_linenumber") == 4, F.concat(c["partkey"], F.lit("sr-"), c["suppkey"], F.lit("-"), c["linenumber"]))
        .when(F.col("l_linenumber") == 5, F.concat(c["partkey"], F.lit("-x"), c["suppkey"], F.lit("-"), c["linenumber"], F.lit("-"), c["partkey"], F.lit("-"), c["suppkey"]))
        .otherwise(F.concat(c["partkey"], F.lit(","), c["suppkey"], F.lit(", "), c["linenumber"], F.lit("/"), c["suppkey"]))
    )
    valid, slots = text.parse_dose(dose)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", valid.alias("valid"), *[s.alias(n) for s, n in zip(slots, text.DOSE_SLOTS)])


@query("token_strip", "F7", "select p_partkey, trim(replace(concat('  Symptom - ', p_name, ' '), 'Symptom - ', '')) as name from part")
def token_strip(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_token(F.concat(F.lit("  Symptom - "), F.col("p_name"), F.lit(" ")), "Symptom - ").alias("name"))


@query("clean_descriptions", "F8", r"""
with d as (select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(concat(doc_id, '. ', case when doc_id % 3 = 0 then 'Snap: ' else '' end, text), '^\d+[^A-Za-z]*', ''),
  '^SNAP[^A-Za-z]*', '', 'i'), '^SSRS[^A-Za-z]*', '', 'i'), '^PCRC[^A-Za-z]*', '', 'i'), '^SCID[^A-Za-z]*', '', 'i'),
  '^CBCL[^A-Za-z]*', '', 'i'), '^MASC[^A-Za-z]*', '', 'i'), '^EXPECT[^A-Za-z]*', '', 'i'))) as description from documents) select * from d""")
def clean_descriptions(spark, sf_dir):
    raw = F.concat(F.col("doc_id").cast("string"), F.lit(". "), F.when(F.col("doc_id") % 3 == 0, "Snap: ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_description(raw)).alias("description"))


@query("parent_wording", "F8", r"""
select p_partkey, case when p_size % 2 = 0 then trim(p_name) else concat('Child. ', p_name) end as wording from part""")
def parent_wording(spark, sf_dir):
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Child. I do. PARENT. "), F.col("p_name"))).otherwise(F.concat(F.lit("Child. "), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", text.parent_wording(said).alias("wording"))


_FEATURE_SQL = """concat(case p_size % 4 when 0 then 'num__' when 1 then 'cat_str__' when 2 then 'ord__' else '' end, lower(p_type), '_', replace(p_name, ' ', '_'), '_', substr('mftc', cast(p_size % 4 + 1 as int), 1))"""


def _feature():
    prefix = F.when(F.col("p_size") % 4 == 0, "num__").when(F.col("p_size") % 4 == 1, "cat_str__").when(F.col("p_size") % 4 == 2, "ord__").otherwise("")
    rater = F.substr(F.lit("mftc"), F.col("p_size") % 4 + 1, F.lit(1))
    return F.concat(prefix, F.lower("p_type"), F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), rater)


@query("feature_name_parts", "F9", f"""
with f as (select p_partkey, regexp_replace({_FEATURE_SQL}, '^(num__|cat_str__|cat_num__|ord__)', '') as name from part),
s as (select *, string_split(name, '_') as x from f)
select p_partkey, name, upper(x[1]) as questionnaire, array_to_string(x[2:len(x) - 1], '_') as item, upper(x[-1]) as rater from s""")
def feature_name_parts(spark, sf_dir):
    q, i, r = text.feature_parts(_feature())
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_prefix(_feature()).alias("name"), q.alias("questionnaire"), i.alias("item"), r.alias("rater"))


@query("lines_and_maps", "F10", """
select p_partkey, p_brand as brand, cast(p_size as varchar) as size, concat('Brand: ', p_brand, chr(10), 'Size: ', p_size, chr(10), 'Name: ', p_name) as lines from part""")
def lines_and_maps(spark, sf_dir):
    raw = F.concat(F.lit("  Brand: "), F.col("p_brand"), F.lit("\n   Size: "), F.col("p_size").cast("string"), F.lit("\nno pair here\n   Name: "), F.col("p_name"))
    m = text.lines_to_map(raw)
    part = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return part.select("p_partkey", F.try_element_at("m", F.lit("Brand")).alias("brand"), F.try_element_at("m", F.lit("Size")).alias("size"), text.map_to_lines("m").alias("lines"))


@query("stored_params", "F11", "select p_partkey, cast(p_size as varchar) as max_depth, cast(null as varchar) as max_features, p_brand as label from part")
def stored_params(spark, sf_dir):
    raw = F.concat(F.lit("{'max_depth': "), F.col("p_size").cast("string"), F.lit(", 'max_features': None, 'label': '"), F.col("p_brand"), F.lit("'}"))
    m = text.parse_params(raw)
    return table(spark, sf_dir, "part").select("p_partkey", m["max_depth"].alias("max_depth"), m["max_features"].alias("max_features"), m["label"].alias("label"))


@query("bracketed_numbers", "F12", "select o_orderkey, [o_totalprice, null, cast(o_orderkey as double)] as numbers from orders")
def bracketed_numbers(spark, sf_dir):
    raw = F.concat(F.lit("["), F.col("o_totalprice").cast("string"), F.lit("  nan_text "), F.col("o_orderkey").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_numbers(raw).alias("numbers"))


@query("truncated_values", "F13", "select c_custkey, case when c_acctbal / 7 < 0 then -(floor(abs(c_acctbal / 7) * 1e4) / 1e4) else floor(abs(c_acctbal / 7) * 1e4) / 1e4 end as cut from customer")
def truncated_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.truncate(F.col("c_acctbal") / 7, 4).alias("cut"))


@query("rounded_values", "F14", "select c_custkey, round(cast(c_acctbal as decimal(12,2)), 1)::double as one, round(cast(c_custkey * 0.125 as decimal(12,3)), 2)::double as two from customer")
def rounded_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.round_to(F.col("c_acctbal").cast("decimal(12,2)"), 1).cast("double").alias("one"),
                                                   numbers.round_to((F.col("c_custkey") * 0.125).cast("decimal(12,3)"), 2).cast("double").alias("two"))


@query("discount_rates", "F15", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_tax <> 0 then (l_quantity - l_tax) / (l_tax * 0.25) end as k, cast(null as double) as k_now from lineitem")
def discount_rates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.discount_rate("l_tax", "l_quantity", 0.25).alias("k"),
                                                   numbers.discount_rate("l_tax", "l_quantity", 0.0).alias("k_now"))


@query("discount_rate_grid", "F16", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"case when l_discount <> 0 and {d:g} <> 0 then (l_quantity - l_discount) / (l_discount * {d}::double) end as disc_rate_k{str(d).rstrip('0').rstrip('.').replace('.', '_')}" for d in numbers.DELAYS) + " from lineitem")
def discount_rate_grid(spark, sf_dir):
    g = numbers.discount_grid(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"), {d: "l_discount" for d in numbers.DELAYS}, "l_quantity")
    return g.drop("l_quantity", "l_discount").withColumnRenamed("disc_rate_k0.25", "disc_rate_k0_25")


@query("direction_symbols", "F17", "select c_custkey, case when c_custkey % 20 / 100 < 0.05 and c_acctbal > 0 then '<' when c_custkey % 20 / 100 < 0.05 and c_acctbal < 0 then '>' else '~' end as symbol from customer")
def direction_symbols(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.direction("c_acctbal", F.col("c_custkey") % 20 / 100).alias("symbol"))


@query("agreement_flags", "F18", """
select doc_id, case when coalesce(quality = 1, false) and coalesce(toxic = 1, false) then 'both' when coalesce(quality = 1, false) or coalesce(toxic = 1, false) then 'one' else 'none' end as agreement from labels""")
def agreement_flags(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", numbers.agreement(F.col("quality") == 1, F.col("toxic") == 1).alias("agreement"))


@query("formula_texts", "F19", "select distinct concat(p_type, ' ~ arm * day * ', p_brand) as formula from part")
def formula_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.formula_text("p_type", F.lit("arm * day"), "p_brand").alias("formula")).distinct()


@query("prompt_texts", "F20", r"""
select item_id, md5(concat('Provide many single words and some short phrases related to item ', item_id, '. Each token should be separated by a semicolon. Do not return duplicate tokens. Do not provide any explanation or additional text beyond the tokens.', chr(10), 'Here is a definition of item ', item_id, ': ',
  trim(lower(regexp_replace(concat(text, ' (Source, 1999)'), '\([^\n)]*\)', '', 'g'))), chr(10), 'Here are some examples (include these in the list): a; b.')) as prompt from benchmark""")
def prompt_texts(spark, sf_dir):
    term = F.concat(F.lit("Item_"), F.col("item_id").cast("string"))
    p = text.prompt_text(term, F.concat(F.col("text"), F.lit(" (Source, 1999)")), examples=F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(p).alias("prompt"))


@query("response_phrases", "F21", """
select item_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') as phrases from benchmark""")
def response_phrases(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.phrases("text", ". ").cast("array<string>").alias("phrases"))


@query("question_words", "F22", r"""
select word, count(*) as n from (select unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) as word from documents) where word <> '' group by word""")
def question_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(text.words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("fixed_scores", "F14", _V + f"select visit_id, {sfix('score * 3.7')} as score from visits")
def fixed_scores(spark, sf_dir):
    return visits(spark, sf_dir).select("visit_id", fixed(F.col("score") * 3.7).alias("score"))
