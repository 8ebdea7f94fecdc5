"""Checked queries: item text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwave.functions.numbers import fixed
from armwave.operators import describe, vectors
from armwave.plans.base import table
from armwave.plans.registry import query, sfix

_CENTRES = """e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
c as (select label, list(m order by i) as w from (select label, i, avg(x) as m from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by label, i) group by label)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _centres(spark, sf_dir):
    return describe.mean_vector(_vectors(spark, sf_dir), "label", "vector", 64).withColumnRenamed("label", "term")


@query("text_vectors", "E1", None)
def text_vectors(spark, sf_dir):
    return vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", size=128).select("doc_id", "vector")


@query("centre_similarities", "E2 G14", "with " + _CENTRES + f" select vec_id as a_id, c.label as b_id, {sfix('list_cosine_similarity(v, w)')} as similarity from e, c")
def centre_similarities(spark, sf_dir):
    pairs = vectors.cosine_pairs(_vectors(spark, sf_dir), _centres(spark, sf_dir), "vec_id", "term")
    return pairs.withColumn("similarity", fixed("similarity"))


@query("best_centres", "E3", "with " + _CENTRES + f""", r as (select vec_id, c.label, list_cosine_similarity(v, w) as s, row_number() over (partition by vec_id order by list_cosine_similarity(v, w) desc, c.label) as k from e, c)
select vec_id as a_id, label as b_id, {sfix('s')} as similarity, cast(k as int) as rank from r where k <= 3""")
def best_centres(spark, sf_dir):
    best = vectors.best_match(_vectors(spark, sf_dir), _centres(spark, sf_dir), "vec_id", "term", k=3)
    return best.withColumn("similarity", fixed("similarity"))


@query("best_vector_matches", "E3", "with " + _CENTRES + f""", r as (select a.vec_id as a_id, b.vec_id as b_id, list_cosine_similarity(a.v, b.v) as s from e a join e b on a.label < 5 and b.label >= 5),
k as (select *, row_number() over (partition by a_id order by s desc, b_id) as k from r)
select a_id, b_id, {sfix('s')} as similarity, 1::int as rank from k where k = 1""")
def best_vector_matches(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    best = vectors.best_match(e.where("label < 5"), e.where("label >= 5"), "vec_id", "vec_id", max_bytes=1 << 16)
    return best.withColumn("similarity", fixed("similarity"))


@query("best_single_pair", "E3", "with " + _CENTRES + f" select a.vec_id as a_id, b.vec_id as b_id, {sfix('list_cosine_similarity(a.v, b.v)')} as similarity from e a join e b on a.label < 5 and b.label >= 5 order by list_cosine_similarity(a.v, b.v) desc limit 1")
def best_single_pair(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    best = vectors.best_pair(vectors.best_match(e.where("label < 5"), e.where("label >= 5"), "vec_id", "vec_id"))
    return best.select("a_id", "b_id", fixed("similarity").alias("similarity"))


@query("projected_vectors", "E4", None)
def projected_vectors(spark, sf_dir):
    return vectors.project(_vectors(spark, sf_dir), "vector", 2).select("vec_id", "projected")


_CLUSTER_SQL = """with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings),
n as (select a.vec_id as u, b.vec_id as w from e a join e b on a.vec_id <> b.vec_id and list_distance(a.v, b.v) <= 1.1),
reach as (select vec_id as u, vec_id as w from e union select r.u, n.w from reach r join n on n.u = r.w),
root as (select u, min(w) as root from reach group by u),
named as (select u as vec_id, case when count(*) over (partition by root) >= 2 then root else -1 end as cluster from root) """


@query("vector_clusters", "E5", _CLUSTER_SQL + "select vec_id, cluster from named")
def vector_clusters(spark, sf_dir):
    return vectors.density_clusters(_vectors(spark, sf_dir), "vec_id", "vector", 1.1)


@query("vector_cluster_members", "E6", _CLUSTER_SQL + """
select cluster, vec_id, count(*) over (partition by cluster) as n from named where cluster <> -1 union all select -1, vec_id, null from named where cluster = -1""")
def vector_cluster_members(spark, sf_dir):
    c = vectors.density_clusters(_vectors(spark, sf_dir), "vec_id", "vector", 1.1)
    alone = vectors.outliers(c).withColumn("n", F.lit(None).cast("bigint"))
    return vectors.cluster_members(c).select("cluster", "vec_id", "n").unionByName(alone.select("cluster", "vec_id", "n"))


@query("vocabulary_terms", "E7", "select p_name as term, p_brand as definition from part where p_type in ('SMALL', 'ECONOMY') and p_size > 10")
def vocabulary_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("definition"), F.col("p_type").alias("use"))
    return vectors.vocab_table(part, "term", "definition", "use", ["SMALL", "ECONOMY"])
