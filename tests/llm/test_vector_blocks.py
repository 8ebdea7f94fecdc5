"""Near-duplicate vectors: copies of vectors, and links of large groups."""

import numpy as np

from armwave.llm import vectors


def test_vectors_are_copied_a_few_times():
    """Blocks of 2,048 vectors meant 301 copies of each of 615,384 vectors."""
    assert vectors._cuts(615_384, 64, 4, 8) <= 10
    assert vectors._cuts(100_000_000, 64, 4, 8) == -(-100_000_000 // 65_536)  # what a task can hold
    assert vectors._cuts(1_000, 64, 4, 8) == 1 and vectors._cuts(1_000, 64, 4, 8, 50) == 20


def test_tiles_and_joined_links_give_the_same_classes(spark, monkeypatch):
    """Small tiles and groups joined link by link, in blocks of any number, against all pairs."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base + 0.05 * rng.standard_normal((40, 16)) for _ in range(6)] + [rng.standard_normal((60, 16))]).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = {i: int(near[i].sum()) - 1 for i in range(len(v))}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    whole = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_classes(df).collect()}
    cut = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_classes(df, block=45).collect()}
    assert whole == cut and {k: n for k, (n, _) in whole.items()} == want

    monkeypatch.setattr(vectors, "TILE", (7, 11))
    monkeypatch.setattr(vectors, "EDGES", 5)
    import pyarrow as pa

    r, spread = vectors.directions(16), float(np.sqrt(0.2))
    task = vectors._counter(r, vectors.WINDOW * spread / 4, vectors.required_collisions(), 0.9, spread * float(np.linalg.norm(r[0])) * (1 + 1e-9))
    t = pa.table({"rep": np.arange(len(v)), "copies": np.ones(len(v), np.int64), "v": pa.array(v.tolist(), pa.list_(pa.float32())), "block": np.zeros(len(v), np.int32), "i": np.zeros(len(v), np.int32), "j": np.zeros(len(v), np.int32)})
    got = {k: (n, root) for k, root, n in zip(*(c.to_pylist() for c in task(t).columns))}
    assert {k: got.get(k, (0, k)) for k in whole} == whole
