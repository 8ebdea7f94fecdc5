"""Hard negatives against brute force: ties, signs, nulls, odd lengths, repeated rows, hot labels, very large components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from armwave.llm import negatives


def brute(rows, every, k=5, low=80, high=100):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v and not any(x is None or x != x or abs(x) == math.inf for x in v)]
    out = []
    for i, lab, a in good:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in good if len(a) == len(b))
        for p, j, _ in [s for s in scored if s[2] == lab and s[1] != i][:k]:
            fits = [s for s in scored if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(i, j, r, x, -p, -s) for r, (s, x, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def vectors(seed, n, dim, kind):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(4)]

    def one():
        if kind == "ties":
            return [draw.choice([-1.0, 0.0, 0.5]) for _ in range(dim)]
        if kind == "signs":
            return [-abs(draw.gauss(0, 1)) for _ in range(dim)]
        if kind == "large":
            return [draw.gauss(0, 1) * 2e6 for _ in range(dim)]
        return [x + 0.4 * draw.gauss(0, 1) for x in draw.choice(centres)]
    labels = [0] * 3 + [1, 2, None] if kind != "signs" else [-1, 7]
    return [(i, draw.choice(labels), one()) for i in range(n)]


@pytest.mark.parametrize("kind, dim, block, cell", [("near", 8, 50, 1 << 32), ("ties", 5, 64, 1000), ("signs", 6, 2048, 1 << 32), ("large", 4, 40, 5000)])
def test_brute_force(spark, kind, dim, block, cell):
    rows = vectors(3, 400, dim, kind)
    rows += [(1000, 0, None), (1010, None, [1.0] * dim), (1020, 0, []), (1030, 0, [float("nan")] * dim), (1040, 1, [None] * dim), (1050, 1, [math.inf] * dim), (None, 0, [1.0] * dim),
             (1060, 0, [0.0] * dim), (1070, 2, [0.0] * dim), (1080, 1, [3.0]), (1081, 1, [2.0]), (1082, 2, [2.0]), (1090, 5, [1.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for i, name in enumerate(["id", "v", "dim", "pos", "at", "windows", "asks", "rank", "x"]):
        df = df.withColumn(name, F.lit(i))
    got = negatives.mine(df.repartition(5), F.col("vec_id") % 10 == 0, block=block, group=16, cell_pairs=cell)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10)
    assert len(brute(rows, 10)) > 30


def test_repeated_rows(spark):
    rows = vectors(5, 120, 6, "near")
    df = spark.createDataFrame(rows * 2, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, block=32).collect()), key=str)
    assert got == brute(rows * 2, 10)


def test_empty(spark):
    shape = "vec_id long, label int, embedding array<double>"
    assert negatives.mine(spark.createDataFrame([], shape), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, 1, [1.0, 2.0]), (11, 2, [1.0, 2.0])], shape)  # no positives
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(alone, F.lit(None).cast("boolean")).count() == 0


def test_lists_are_left_early():
    """Where few rows have large components, the threshold falls below the bars long before all rows are seen."""
    draw = np.random.default_rng(1)
    x = negatives.scaled(draw.lognormal(0, 1.5, (4000, 3)) * draw.choice([-1, 1], (4000, 3)))
    labels = np.zeros(4000, object)
    search = negatives.Search(np.arange(0, 4000, 100), labels[::100], x[::100], np.full((40, 1), -np.inf), np.full((40, 1), np.inf), 5, True)
    for first in range(0, 4000, 1000):
        own = x[first: first + 1000]
        search.visit(negatives.Block(np.arange(first, first + 1000), labels[:1000], own, np.argsort(-own, axis=0, kind="stable").T))
    scores = x[::100] @ x.T
    for i in range(40):
        own = [j for j in range(4000) if j != i * 100]
        assert sorted((-scores[i, j], j) for j in own)[:5] == search.top[i][0]
    assert search.seen < 0.5 * search.met
