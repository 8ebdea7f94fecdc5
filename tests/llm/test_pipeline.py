"""The pipeline against brute force and SQL twins, stage by stage."""

import re
from collections import Counter

import duckdb
import pytest
from test_odd_rows import removed, roots, shingles

import corpus_pipeline
from armwave.llm.queries import SQL
from armwave.session import scratch_path


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [o.toPandas() for o in out]


def twin(name, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(SQL[name]).df()


def test_columns_and_order(results):
    for frame in results[:-1]:
        assert list(frame.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_quality_rules(results):
    want = twin("op7_quality_rules", results[0])
    assert sorted(results[1].doc_id) == sorted(want.doc_id[want.kept])


def test_near_duplicates(results):
    docs = results[1].sort_values("doc_id")
    sets = [shingles(t) for t in docs.text]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(len(sets), linked)
    assert linked and sorted(results[2].doc_id) == [d for i, d in enumerate(docs.doc_id) if root[i] == i]


def test_repeated_passages(results):
    """Runs of words that occur twice are gone, all others stay; texts are compared word by word."""
    n = corpus_pipeline.REPEATED_WORDS
    docs = results[2].sort_values("doc_id").reset_index(drop=True)
    words = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in docs.text]
    gone = removed([tuple(m[0] for m in w) for w in words], n)
    want = {}
    for d, t, w, g in zip(docs.doc_id, docs.text, words, gone):
        out, done = [], 0
        for m in re.finditer(b"\1+", bytes(g)):
            out.append(t[done: w[m.start()].start()])
            done = w[m.end() - 1].end()
        want[d] = "".join([*out, t[done:]])
    got = dict(zip(results[3].doc_id, results[3].text))
    assert got == want and any(len(want[d]) < len(t) for d, t in zip(docs.doc_id, docs.text))
    assert (results[3].n_chars == results[3].text.str.len()).all()


def test_mix(results):
    want = twin("op9_mixing", results[3])
    copies = {d: len(s) for d, s in zip(want.doc_id, want.shards) if len(s)}
    assert Counter(results[4].doc_id) == Counter(copies)


def test_pieces(results):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    last = results[5]
    assert len(last) == len(results[4]) and last.round_trip.all()
    for text, ids in zip(last.text, last.piece_ids):
        assert whole.encode(text) == list(ids)


def test_run_gives_the_last_stage(spark, sf_dir, results):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == list(results[5].columns) and got.count() == len(results[5])
