"""Character models against a plain Kneser-Ney, held-out accuracy, and odd rows."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from armwave.llm import languages


def symbols(text):
    """Letters of a text with single borders between and after words, as the model sees them."""
    out = []
    for ch in text.lower():
        if unicodedata.category(ch)[0] in "LM":
            out.append(ch)
        elif out and out[-1] != " ":
            out.append(" ")
    return out + ([" "] if out and out[-1] != " " else [])


def grams(text, order):
    s = [" "] * (order - 1) + symbols(text)
    return [tuple(s[i - order + 1: i + 1]) for i in range(order - 1, len(s))]


def plain_model(texts, order):
    """A function n-gram -> probability, straight from the definition."""
    counts = Counter(g for t in texts for g in grams(t, order))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    parts = {}
    for k, c in levels.items():
        n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        total, left = defaultdict(int), defaultdict(lambda: 1.0)
        for g, n in c.items():
            total[g[:-1]] += n
        for g, n in c.items():
            left[g[:-1]] -= max(n - d, 0) / total[g[:-1]]
        parts[k] = (c, d, total, left)

    def p(g):
        out = 1 / 4096
        for k in range(1, order + 1):
            c, d, total, left = parts[k]
            own = g[order - k:]
            out = (max(c[own] - d, 0) / total[own[:-1]] if own[:-1] in total else 0.0) + left[own[:-1]] * out
        return out
    return p


def invented(lang, draw, n):
    syllables = {"aa": ["ta", "ri", "mo", "ne"], "bb": ["shk", "olv", "ern", "tz"], "cc": ["ταυ", "ρο", "μια", "νε"]}[lang]
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = [(i, invented(lang := draw.choice(["aa", "aa", "bb", "cc"]), draw, draw.randint(2, 40)), lang) for i in range(400)]
    odd = [None, "", " \n", "123 !?", "\x00", "日本語", "é" * 3, "x", "́̂", "Tari\x00mone", "İx ß", "ta " * 30000]
    return out + [(1000 + i, t, None) for i, t in enumerate(odd)] + [(None, "ta ri mo", None), (None, None, "aa"), (3, "ta ri", "aa"), (3, "ta ri", "aa")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for i, name in enumerate(["id", "t", "g", "c", "n", "bits", "best", "low", "trains"]):
        df = df.withColumn(name, F.lit(i))
    return df.repartition(4)


@pytest.mark.parametrize("order", [2, 4, 5])
def test_plain_kneser_ney(spark, docs, rows, order):
    models = languages.fit(docs.where("text is not null and lang is not null").select("lang", F.col("text").alias("t")), order)
    assert models.langs == ["aa", "bb", "cc"]
    texts = {lang: [t for _, t, x in rows if x == lang and t is not None] for lang in models.langs}
    plain = [plain_model(texts[lang], order) for lang in models.langs]
    asked = [t for _, t, x in rows if t is not None and len(t) < 1000][:60] + ["tarix mo'ne", "shkolv ταυ", "Ωmega"]
    n, bits, _ = languages.Scorer(models).entropies(asked, order)
    for t, own, got in zip(asked, n, bits):
        g = grams(t, order)
        assert own == len(g)
        if g and all(ord(ch) < 0xC00 for ch in t.lower()):
            assert got == pytest.approx([-sum(math.log2(p(x)) for x in g) / len(g) for p in plain])


def test_pruned_models_stay_distributions(docs):
    models = languages.fit(docs.where("text is not null and lang is not null").select("lang", F.col("text").alias("t")), 3, 0.004)
    for i in range(len(models.langs)):
        assert all(len(k) <= 1 / (0.004 * 3) for k, _ in models.grams[i])
        for h in (0, *models.histories[i][2][0][:3].tolist()):
            import numpy as np

            g = (int(h) << 12) + np.arange(4096)
            assert (2 ** models.log2(g)[:, i]).sum() == pytest.approx(1.0)


def test_identify(docs, rows):
    part = languages.part_of(F.col("doc_id"))
    got = languages.identify(docs, part.isin(0, 1), part == 3).withColumn("part", part)
    assert got.count() == len(rows)
    found = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    known = [(found[k], lang) for k, t, lang in rows[:400]]
    held = [r.lang_pred == lang for r, lang in known if r.part == 2]
    assert len(held) > 60 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values()) and sum(r.accepted for r, _ in known) > 0.9 * len(known)
    for i in range(5):
        assert found[1000 + i].lang_pred == "und" and found[1000 + i].score == 0.0 and not found[1000 + i].accepted
    assert found[1008].lang_pred == "und" and found[1009].lang_pred == "aa" and found[1011].lang_pred == "aa"
    assert not found[1005].accepted  # letters that no model knows
    assert sorted(r.lang_pred for r in got.where("doc_id is null").collect()) == ["aa", "und"]


def test_held_out_labels_are_not_read(docs):
    part = languages.part_of(F.col("doc_id"))
    run = lambda df: sorted(map(tuple, languages.identify(df, part.isin(0, 1), part == 3).collect()), key=str)
    other = docs.withColumn("lang", F.when(part != 2, F.col("lang")))
    assert run(docs) == run(other)


def test_empty(docs):
    part = languages.part_of(F.col("doc_id"))
    assert languages.identify(docs.limit(0), part.isin(0, 1), part == 3).count() == 0
    nothing = languages.identify(docs, F.lit(False), part == 3)
    assert nothing.where("lang_pred <> 'und' or score <> 0").count() == 0 and nothing.count() == docs.count()
