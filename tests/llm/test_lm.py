"""Scores against the model written in SQL, and against the unigram score on held-out texts."""

import compare
import pytest
from pyspark.sql import functions as F

from armwave.llm import lm
from armwave.llm.queries import QUERIES

MODEL = r"""
with d as (select doc_id, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+'), ['<end> ']) as w from documents),
t as (select doc_id, i, w[i] as w, coalesce(w[i-1], '<s> ') as v, case when i > 2 then w[i-2] else '<s> ' end as u
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
t2 as (select doc_id, i, w, case when i > 1 then v else '<s> ' end as v, u from t),
r as (select t2.* from t2 join held using (doc_id) where not held_out),
c1 as (select w, count(*) as c from r group by w), c2 as (select v, w, count(*) as c from r group by all), c3 as (select u, v, w, count(*) as c from r group by all),
h1 as (select v, count(*) as c from r group by v), h2 as (select u, v, count(*) as c from r group by all),
n as (select count(*) as nn, count(distinct w) as nv from r),
p as (select doc_id, coalesce(c1.c, 0) as c, (coalesce(c1.c, 0) + 1) / (nn + nv + 1) as p1, coalesce(c2.c, 0) as c2, coalesce(h1.c, 0) as h1, coalesce(c3.c, 0) as c3, coalesce(h2.c, 0) as h2
  from t2 cross join n left join c1 using (w) left join c2 using (v, w) left join c3 using (u, v, w) left join h1 using (v) left join h2 using (u, v)),
q as (select *, (c2 + {m1} * p1) / (h1 + {m1}) as p2 from p)
select doc_id, count(*) as n_tokens, count(*) filter (c > 0) as n_known, sum(log10(p1)) as base_score, sum(log10((c3 + {m2} * p2) / (h2 + {m2}))) as score
from q group by doc_id"""


def test_same_as_sql(spark, sf_dir):
    got = QUERIES["op5_lm_scoring"](spark, sf_dir).toPandas().set_index("doc_id").sort_index()
    con = compare.duck(sf_dir)
    con.register("held", got.reset_index()[["doc_id", "held_out"]])
    want = con.execute(MODEL.format(m1=lm.PRIORS[1], m2=lm.PRIORS[2])).df().set_index("doc_id").sort_index()
    assert (got[["n_tokens", "n_known"]] == want[["n_tokens", "n_known"]]).all().all()
    assert abs(got.base_score - want.base_score).max() < 1e-6
    assert abs(got.score - want.score).max() < 1e-6
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert got.train_tokens.nunique() == 1 and got.train_tokens.iloc[0] == got.n_tokens[~got.held_out].sum()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b a"), (3, "A b"), (3, "A b"), (4, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    got = lm.score(docs, F.lit(False)).toPandas()
    assert len(got) == 6 and got.n_tokens.sum() == 1 + 1 + 4 + 3 + 3 + 2
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0
    none = lm.score(docs, F.lit(True)).toPandas()
    assert (none.n_known == 0).all() and (none.base_score == 0).all()


@pytest.mark.parametrize("keys", [[], [5], [1, 2**63, 2**64 - 1], list(range(0, 2**40, 2**31))])
def test_squeezed_hashes(keys):
    import numpy as np

    x = np.array(keys, dtype=np.uint64)
    if len(x):
        assert (lm._unsqueeze(lm._squeeze(x)) == x).all()


def test_long_texts_and_other_orders(spark):
    """Texts beyond a lane, repeats and unseen words, against the formula written out; models of one, two and four words of history."""
    import numpy as np

    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{int(i)}" for i in draw.integers(0, 12, n) ** 2 // 9) for n in (1700, 3, 513, 512, 511, 1, 1025, 40)] + ["new words only", ""]
    held = {1, 4, 8}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for priors in ((None,), (None, 3.0), lm.PRIORS, (None, 5.0, 2.0, 0.5)):
        got = lm.score(docs, F.col("doc_id").isin(*held), priors=priors).toPandas().set_index("doc_id").score
        grams, words = {}, {i: t.split() + ["</s>"] for i, t in enumerate(texts)}
        for i, w in words.items():
            full = ["<s>"] * (len(priors) - 1) + w
            for at in range(len(w)):
                for k in range(len(priors)):
                    g = tuple(full[at + len(priors) - 1 - k: at + len(priors)])
                    if i not in held:
                        grams[g] = grams.get(g, 0) + 1
        n_texts = len(texts) - len(held)
        tokens = sum(c for g, c in grams.items() if len(g) == 1)
        distinct = sum(len(g) == 1 for g in grams)

        def p(g):
            if len(g) == 1:
                return (grams.get(g, 0) + 1) / (tokens + distinct + 1)
            history = n_texts if set(g[:-1]) == {"<s>"} else grams.get(g[:-1], 0)
            return (grams.get(g, 0) + priors[len(g) - 1] * p(g[1:])) / (history + priors[len(g) - 1])

        for i, w in words.items():
            full = ["<s>"] * (len(priors) - 1) + w
            want = sum(np.log10(p(tuple(full[at: at + len(priors)]))) for at in range(len(w)))
            assert got[i] == pytest.approx(want, rel=1e-9)
