"""Matching and clustering against brute force, with piles of copies and near copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armwave.operators import vectors


def brute_clusters(x, eps, min_size):
    n = len(x)
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) <= eps * eps
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(axis=1)
        if (low == label).all():
            break
        label = low
    size = np.bincount(label, minlength=n)
    return np.where(size[label] >= min_size, label, -1)


@pytest.mark.parametrize("seed,eps,min_size,pivots", [(1, 0.3, 2, None), (2, 0.5, 3, 8), (3, 0.15, 2, 40), (4, 0.9, 2, 5)])
def test_density_clusters(spark, seed, eps, min_size, pivots):
    rng = np.random.default_rng(seed)
    spread = rng.uniform(0, 4, size=(160, 3))
    pile = np.array([1.0, 1.0, 1.0]) + rng.normal(scale=eps / 20, size=(60, 3))
    second = np.array([1.0 + eps * 1.1, 1.0, 1.0]) + rng.normal(scale=eps / 20, size=(30, 3))
    x = np.vstack([spread, pile, second, np.repeat(spread[:1], 50, axis=0)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vector": list(x)})).repartition(4)
    got = vectors.density_clusters(df, "id", "vector", eps, min_size, pivots).toPandas().set_index("id")["cluster"].sort_index()
    assert (got.to_numpy() == brute_clusters(x, eps, min_size)).all()


def test_small_blocks_give_the_same_links(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, size=(120, 2))
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "v": list(x)})).withColumn("cell", F.lit(0))
    links = vectors._block_links(points, points, 0.1, block=17)
    roots = vectors.components(links).toPandas().set_index("u")["root"]
    got = np.array([roots.get(i, i) for i in range(120)])
    assert (got == np.where((b := brute_clusters(x, 0.1, 1)) == -1, np.arange(120), b)).all()
    assert links.count() <= 120 * 2 * 8 * 8


def test_points_are_not_copied_to_cells(spark, monkeypatch):
    """With a radius that reaches every pivot a point stays one row; piles, blocks and tiny tiles give the clusters of all pairs."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(150, 6)), 4 + rng.normal(size=(60, 6)) / 50, 4.4 + rng.normal(size=(40, 6)) / 50])
    x /= np.where(np.arange(250) < 150, np.linalg.norm(x, axis=1), 1)[:, None]
    monkeypatch.setattr(vectors, "PLACE_BYTES", 4096)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 30)
    stored = []
    cut = vectors.cut_lineage
    monkeypatch.setattr(vectors, "cut_lineage", lambda df: stored.append(df.columns) or (lambda made: stored.append(made.count()) or made)(cut(df)))
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(250), "v": list(x)}))
    roots = dict(vectors.components(vectors.near_edges(points, 0.9, 9)).toPandas().itertuples(index=False))
    assert stored[1] == 250
    own = np.arange(250)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.81
    while not np.array_equal(low := np.where(near, own[None, :], 250).min(axis=1), own):
        own = low
    assert [roots.get(i, i) for i in range(250)] == own.tolist() and 1 < len(set(own)) < 200


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order[:-1], order[1:])] + [(1000, 1001), (1002, 1001)], "u long, v long")
    got = {r["u"]: r["root"] for r in vectors.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, n)) and got[1001] == got[1002] == 1000 and 0 not in got
    assert vectors.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("k,max_bytes", [(1, 64 << 20), (3, 64 << 20), (1, 600), (4, 600)])
def test_best_match(spark, k, max_bytes):
    rng = np.random.default_rng(k)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(50, 5))
    b[20:40] = b[3]  # copies: ties go to the smallest id
    frames = [spark.createDataFrame(pd.DataFrame({"id": np.arange(len(m)) + 100, "vector": list(m)})).repartition(3) for m in (a, b)]
    got = vectors.best_match(*frames, "id", "id", k=k, max_bytes=max_bytes).toPandas().sort_values(["a_id", "rank"])
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b)]
    sims = unit[0] @ unit[1].T
    # equal vectors may differ in the last digit between blocks, so compare similarities and check the vectors
    want = -np.sort(-sims, axis=1)[:, :k]
    np.testing.assert_allclose(got.similarity.to_numpy().reshape(40, k), want, atol=1e-12)
    assert got.groupby("a_id").b_id.nunique().eq(k).all()


def test_blocks_of_matches_do_not_follow_the_broadcast_limit(spark, monkeypatch):
    """Sides beyond a small broadcast limit meet in few blocks; blocks and tiles of any size give the matches of all pairs."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 5))
    a = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "vector": list(x[:120])}))
    b = spark.createDataFrame(pd.DataFrame({"id": np.arange(120, 300), "vector": list(x[120:])}))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = 120 + (unit[:120] @ unit[120:].T).argmax(axis=1)
    sent, meet = [], vectors.block_pairs
    monkeypatch.setattr(vectors, "block_pairs", lambda *args: sent.append(args[-2:]) or meet(*args))
    for rows, tile in ((vectors.BLOCK_ROWS, vectors.TILE_BYTES), (50, 4000)):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
        monkeypatch.setattr(vectors, "TILE_BYTES", tile)
        got = vectors.best_match(a, b, "id", "id", max_bytes=64).toPandas().sort_values("a_id")
        assert got.b_id.tolist() == want.tolist()
    assert sent[0][0] >= 300 and sent[1] == (50, 50)


def test_cosine_pairs_and_threshold(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, vector array<double>")
    pairs = vectors.cosine_pairs(a, a, "id", "id")
    assert pairs.count() == 4 and vectors.cosine_pairs(a, a, "id", "id", min_sim=0.9).count() == 2
    top = vectors.best_pair(pairs.where("a_id < b_id")).first()
    assert abs(top["similarity"] - 0.5**0.5) < 1e-12


def test_encoders(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, None), (3, "éà one")], "id int, text string")
    own = vectors.embed(df, "text", encoder=lambda texts: np.array([[len(t), t.count("o")] for t in texts]))
    assert {r["id"]: r["vector"] for r in own.collect()} == {1: [11.0, 3.0], 2: [0.0, 0.0], 3: [6.0, 1.0]}
    hashed = {r["id"]: r["vector"] for r in vectors.embed(df, "text", size=16).collect()}
    assert len(hashed[1]) == 16 and abs(np.linalg.norm(hashed[1]) - 1) < 1e-9 and not any(hashed[2])


def test_projection_keeps_variance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 4)) * [5, 2, 0.1, 0.1]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(100), "vector": list(x)}))
    p = np.array([r["projected"] for r in vectors.project(df, "vector", 2).orderBy("id").collect()])
    assert abs(p[:, 0].var() - np.linalg.eigvalsh(np.cov(x.T, ddof=0))[-1]) < 1e-6
