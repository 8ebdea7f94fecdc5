"""The rest of a source against a plain walk: one very long document, thousands of equal rows, no step in a single task."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from armwave.llm import mixing


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def plain(rows, block_rows, seed, share):
    """Words taken by (source, key, text), from the definition: fill the targets, then walk through each source."""
    size = lambda t: len((t or "").split())
    sks = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sks}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sks)}
    target, left, open_ = {}, share * sum(total.values()), set(sks)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] < weight[s] * level}
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        target.update({s: 2.0 * total[s] for s in full})
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    out = []
    for s in sks:
        sk = "" if s is None else "=" + s
        own, seen = [], {}
        for k, t, x in rows:
            if x == s:
                h = md5(seed, "-" if k is None else k, md5(sk), md5(t or ""))
                seen[h] = seen.get(h, 0) + 1
                own.append((md5(f"{seed}n", h, seen[h]), k, size(t)))
        blocks = math.ceil(len(own) / block_rows)
        passes = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - passes * total[s]
        for u, k, n in sorted(own, key=lambda r: (md5(f"{seed}b", sk, int(r[0][:8], 16) % blocks), r[0])):
            more = 0 < n <= rest
            rest -= n if more else 0
            out.append((k, n, (passes + more) * n))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, share", [(1, 0.5), (3, 1.5), (4, 0.1)])
def test_long_document_and_equal_rows(spark, seed, share):
    rows = [(i, "a b c d e" + " f" * (i % 7), "s") for i in range(300)] + [(300, "w " * 1600, "s"), (301, None, "s"), (302, "", "s")]
    rows += [(7, "same text here", "t")] * 5000 + [(None, "x y", None)] * 40 + [(i, "z " * (i % 90), "r") for i in range(400, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.plan(df, share=share, block_rows=32, shards=4, seed=seed).toPandas()
    assert sorted(((None if k != k else int(k), n, t) for k, n, t in zip(got.doc_id, got["size"], got.taken)), key=str) == plain(rows, 32, seed, share)
    assert (got.taken == got.shards.map(len) * got["size"]).all()
    for _, own in got.groupby("target"):
        copies = own.shards.map(len)
        left_out = own["size"][(copies == copies[own["size"] > 0].min()) & (own["size"] > 0)]
        assert 0 <= own.target.iloc[0] - own.taken.sum() < left_out.min()
    whole = mixing.mixed(df, share=share, block_rows=32, shards=4, seed=seed)
    assert whole.columns == df.columns and whole.count() == got.shards.map(len).sum()
    assert sorted(map(tuple, whole.where("source = 't'").distinct().collect())) == ([(7, "same text here", "t")] if whole.where("source = 't'").count() else [])


def test_no_single_task(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n", F.lit(1))
    for out in (mixing.plan(docs), mixing.mixed(docs)):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
