"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from armwave.llm import graph, jaccard, licences, mixing, pieces, quality, suffixes, vectors, warc
from armwave.llm.queries import TOKENIZERS

WORD = r"[^\x20\x09-\x0D]+"
CLASH = ["id", "t", "row", "k", "th", "n", "sk", "ids", "shard", "kept", "label", "_kept"]


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["é", "日本", "A", "b|"]
    base = [draw.choice(words) for _ in range(120)]
    shared = " ".join(draw.choice(words) for _ in range(110))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, " ".join(base)), (None, None), (6, "x" * 9000), (7, "ab " * 2000), (7, "ab " * 2000)]
    for i in range(10, 10 + n):
        kind = draw.randint(0, 3)
        if kind == 0:  # near copies of one text, some of them near each other only through others
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((i, " ".join(own)))
        elif kind == 1:
            rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 90)))))
        elif kind == 2:
            rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(3, 40))) + " " + shared + "\n" + draw.choice(words)))
        else:
            rows.append((i, draw.choice(rows)[1]))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(k, t, "a" if k and k % 3 else None, None) for k, t in rows], "doc_id long, text string, source string, lang string")
    for i, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(i))
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(5)


def shingles(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(n, linked):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_jaccard(docs, rows):
    got = sorted(map(tuple, jaccard.classes(docs).collect()), key=str)
    named = sorted({k: t for k, t in rows if k is not None}.items())
    sets = [shingles(t) for _, t in named]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = {named[i][0]: named[r][0] for i, r in enumerate(roots(len(sets), linked))}
    assert got == sorted([(k, len(shingles(t)), root.get(k)) for k, t in rows], key=str)
    assert jaccard.classes(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(k for k in root if root[k] == k)
    assert kept.where("doc_id is null").count() == 2


def removed(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p: p + length], []).append((d, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p: p + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("length, window", [(400, 192), (40, 8)])
def test_suffixes(docs, rows, length, window):
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (k, _), t, gone in zip(rows, texts, removed(texts, length)):
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((k, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    out = suffixes.cut(docs, length=length, window=window)
    got = out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert suffixes.cut(docs.limit(0), length=length, window=window).count() == 0
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    by_word = suffixes.without_repeats(docs, length=20, window=10, unit="word")
    words = [[m for m in re.finditer(WORD, t or "")] for _, t in rows]
    gone = removed([tuple(m[0] for m in w) for w in words], 20)
    want = []
    for (k, t), w, g in zip(rows, words, gone):
        out, done = [], 0
        for m in re.finditer(b"\1+", bytes(g)):
            out.append(t[done: w[m.start()].start()])
            done = w[m.end() - 1].end()
        want.append((k, None if t is None else "".join([*out, t[done:]])))
    assert sorted(((r.doc_id, r.text) for r in by_word.collect()), key=str) == sorted(want, key=str)
    assert left.where("n_chars <> length(text)").count() == 0 and left.where("text is null").count() == 2 + sum(t is None for _, t in rows) - 2


def test_quality(docs, rows):
    got = quality.measure(docs)
    assert got.count() == len(rows)
    assert got.where("doc_id in (1, 2, 3) and n_words = 0 and fail_bits & 1 = 1").count() == 3
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    assert kept.count() == got.where(quality.verdict()).count()
    ledger = quality.ablations(got).collect()
    assert {r.rule for r in ledger} == set(quality.POLICIES["prose-1"])
    for r in ledger:
        bit = quality.mask_of([r.rule])
        others = quality.mask_of(quality.POLICIES["prose-1"]) & ~bit
        assert r.failed == got.where(f"fail_bits & {bit} <> 0").count()
        assert r.kept_without == got.where(f"fail_bits & {others} = 0").count()
        assert r.only_here == r.kept_without - kept.count()
    assert quality.measure(docs.limit(0)).count() == 0


def test_mixing(docs, rows):
    planned = mixing.plan(docs, block_rows=8, shards=4).toPandas()
    assert len(planned) == len(rows)
    assert (planned.taken <= 2 * planned["size"]).all() and (planned.taken == planned.shards.map(len) * planned["size"]).all()
    for _, own in planned.groupby("target"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    out = mixing.mixed(docs, block_rows=8, shards=4)
    assert out.columns == docs.columns and out.count() == planned.shards.map(len).sum()
    again = mixing.plan(docs.repartition(3), block_rows=8, shards=4).toPandas()
    key = ["row_hash", "taken"]
    assert planned[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_tree_is_even(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    got = mixing.plan(many, block_rows=8, shards=8).select(F.explode("shards").alias("s")).groupBy("s").count().toPandas()
    assert len(got) == 8 and got["count"].max() < 1.5 * got["count"].min()


def test_pieces(spark, docs, rows):
    import sentencepiece

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    model = pieces.load(spark, path)
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["a▁b", "  x \n\n y  ", " " * 47 + "z", "🙂é\x00", "<s>", None])], "doc_id long, text string")
    for df in (docs, odd):
        coded = pieces.encode(df, model)
        assert coded.columns == [*df.columns, "piece_ids"] and coded.count() == df.count()
        for r in pieces.decode(coded, model).collect():
            assert r.piece_ids == (None if r.text is None else whole.encode(r.text))
            assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    assert pieces.decode(pieces.encode(docs.limit(0), model), model).count() == 0


def test_unigram_is_the_best_sum():
    v = pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "aba", "▁a", "ba"], [0, -3.0, -1.0, -1.2, -1.9, -2.6, -3.5, -1.8], [2, 1, 1, 1, 1, 1, 1, 1], True)
    v.id_of = {p: i for i, p in enumerate(v.piece) if i}
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(i % 9)) for i in range(60)} - {""} | {"▁ab", "▁aab"})

    def best(word):
        out = {0: 0.0}
        for e in range(1, len(word) + 1):
            out[e] = max(out[s] + v.score[v.id_of[word[s:e]]] for s in range(e) if word[s:e] in v.id_of)
        return out[len(word)]
    for word, ids in zip(words, pieces.Segmenter(v).words(words)):
        assert "".join(v.piece[i] for i in ids) == word
        assert sum(v.score[i] for i in ids) == pytest.approx(best(word))


def test_vectors(spark):
    draw = random.Random(5)
    near = lambda v, e: [x + e * draw.gauss(0, 1) for x in v]
    base = [[draw.gauss(0, 1) for _ in range(32)] for _ in range(6)]
    rows = [(i, near(draw.choice(base), draw.choice([0.0, 0.05, 0.3, 0.33]))) for i in range(240)]
    rows += [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (304, [None] * 32), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] + [0.0] * 31), (None, rows[0][1]), (308, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rep", F.lit(2))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_classes(df, block=50).collect()}
    good = [(k, v) for k, v in rows if k is not None and v and not any(x is None or x != x or abs(x) == float("inf") for x in v) and any(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    linked = [(i, j) for i in range(len(good)) for j in range(i) if len(good[i][1]) == len(good[j][1])
              and dot(good[i][1], good[j][1]) / (dot(good[i][1], good[i][1]) * dot(good[j][1], good[j][1])) ** 0.5 >= 0.9]
    want = {k: (0, k) for k, _ in rows}
    for (k, _), r, n in zip(good, roots(len(good), linked), [sum(i in p for p in linked) for i in range(len(good))]):
        want[k] = (n, good[r][0])
    assert len(linked) > 500 and got == want
    assert vectors.near_classes(df.limit(0)).count() == 0


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (9, "u", big), (9, "u", big), (None, "u", big),
            (7, "u", "a\r\n\r\nb" * 300), (8, "u", "\r\n" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("uid", F.lit(0)).withColumn("digest", F.lit("d"))
    got = warc.written_and_read(pages).withColumn("page_id", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    texts = {k: (t or "").encode() for k, _, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.payload_bytes == len(texts[r.page_id]) and r.digest == hashlib.sha1(texts[r.page_id]).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else r.payload == texts[r.page_id]
    kinds = sorted((str(r.page_id), r.record_type, r.to) for r in got if r.payload_bytes == 1200)
    assert kinds == sorted([("1", "revisit", 9), ("2", "revisit", 9), ("9", "response", None), ("9", "revisit", 9), ("None", "revisit", 9)])
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 1000)
    assert warc.written_and_read(pages.limit(0)).count() == 0
    path = graph.scratch_path(spark, "again")
    index = warc.write(pages, path)
    scanned = warc.index_archives(spark, path)
    assert index.drop("file").exceptAll(scanned.drop("file")).count() == 0 and scanned.count() == len(rows)
    assert warc.read(index.where("url = 'u'")).count() == index.where("url = 'u'").count()


def test_licences(spark):
    mit = ("Copyright (c) 2020 Jane Doe\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nMIT License\nMIT License")
    rows = [(1, None), (2, ""), (3, mit), (4, "Bla. Licensed under the Apache License, Version 2.0. All rights reserved."), (4, "no licence known"), (None, "(c) Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("left", F.lit(1))
    got = [(r.doc_id, r.licences, r.n_unmatched) for r in licences.scan(df).collect()]
    assert got == [(1, [], 0), (2, [], 0), (3, ["MIT"], 1), (4, ["Apache-2.0", "Proprietary"], 0), (4, [], 0), (None, [], 0)]
    assert licences.scan(df.limit(0)).count() == 0
