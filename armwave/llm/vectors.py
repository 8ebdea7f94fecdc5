"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on ``m`` random directions. Around each vector's value on each direction lies a window; a pair
collides on a direction when the other value falls into it. For a pair at the threshold the projections differ like
a normal variable whose spread the angle gives, so the number of collisions is binomial: the count a pair must
reach is the largest one that a pair at the threshold misses with at most the allowed probability. Pairs
that reach it are verified by their cosine.

Vectors are sorted by their value on the first direction and cut into a few large blocks; a block meets those blocks whose values
lie within the largest possible difference, and the windows of two blocks are counted for all pairs of a tile at once. A vector is
copied once per block that its own meets, so blocks are as large as a task can hold, as long as all tasks have work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.llm.graph import components, stored

DIRECTIONS = 32
WINDOW = 1.5        # half width in spreads of a pair at the threshold
MISSED = 1e-4       # chance that a pair at the threshold is missed
SMALLEST = 2048     # vectors of a block that is not cut for the sake of more tasks
BLOCK_BYTES = 16 << 20  # vectors of a block that a task may hold
TILE = (256, 2048)  # vectors of two blocks whose collisions are counted together
EDGES = 1 << 21     # links that a task holds before they are joined to groups


def required_collisions(m: int = DIRECTIONS, window: float = WINDOW, missed: float = MISSED) -> int:
    """Largest count that a pair at the threshold stays below with a probability of at most ``missed``."""
    p = math.erf(window / math.sqrt(2))
    tail, count = 0.0, 0
    while count <= m:
        tail += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if tail > missed:
            break
        count += 1
    return count


def directions(dim: int, m: int = DIRECTIONS, seed: int = 2) -> np.ndarray:
    """Normal directions, scaled so that differences of unit vectors keep their length on average."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((m, dim)) / math.sqrt(dim)


def _usable(vec: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = v.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(u: np.ndarray, r: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(values on the first direction, values on all directions as bytes that wrap around): far values may collide by chance, near ones always do."""
    p, q = np.empty(len(u)), np.empty((len(r), len(u)), np.uint8)
    for a in range(0, len(u), 1 << 14):
        own = u[a: a + (1 << 14)] @ r.T
        p[a: a + (1 << 14)] = own[:, 0]
        q[:, a: a + (1 << 14)] = np.floor(own / (half / 32)).astype(np.int64).astype(np.uint8).T
    return p, q


def _compare(x: np.ndarray, y: np.ndarray, same: bool, r: np.ndarray, half: float, need: int, least: float, reach: float = math.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two blocks of unit vectors that reach the count of collisions and the cosine, tile by tile."""
    (px, qx), (py, qy) = _bytes(x, r, half), _bytes(y, r, half)
    ox, oy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    px, py, qx, qy = px[ox], py[oy], qx[:, ox], qy[:, oy]
    high, wide = TILE
    for first in range(0, len(x), high):
        end = min(first + high, len(x))
        begin, top = (int(np.searchsorted(py, p, side=s)) for p, s in ((px[first] - reach, "left"), (px[end - 1] + reach, "right")))
        for start in range(begin, top, wide):
            stop = min(start + wide, top)
            count = np.zeros((end - first, stop - start), np.uint8)
            for k in range(len(r)):
                gap = (qx[k, first:end] + np.uint8(33))[:, None] - qy[k, start:stop][None, :]
                count += gap <= np.uint8(66)
            i, j = np.nonzero(count >= need)
            i, j = ox[i + first], oy[j + start]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            for at in range(0, len(i), 1 << 17):
                a, b = i[at: at + (1 << 17)], j[at: at + (1 << 17)]
                hit = np.einsum("ij,ij->i", x[a], y[b]) >= least
                yield a[hit], b[hit]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cuts(n: int, dim: int, width: int, tasks: int, block: int | None = None) -> int:
    """Number of blocks of n vectors of ``dim`` numbers of ``width`` bytes: blocks that a task can hold, and some pairs of them per task."""
    most = block or max(1, BLOCK_BYTES // (dim * width))
    return max(1, -(-n // most), 0 if block else min(-(-n // SMALLEST), math.ceil(math.sqrt(8 * tasks))))


def _counter(r: np.ndarray, half: float, need: int, cosine: float, reach: float):
    """Task of one pair of blocks: per vector its links and the smallest id it reaches in these blocks."""

    def count(t: pa.Table) -> pa.Table:
        blocks, i = t.column("block").to_numpy(), t.column("i")[0].as_py()
        u, copies = _unit(_matrix(t.column("v"))), t.column("copies").to_numpy()
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks != i)
        same_block = t.column("i")[0] == t.column("j")[0]
        if same_block:
            right = left
        reps = t.column("rep").to_numpy()
        rank = np.argsort(reps, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        links, label = np.zeros(len(u)), np.arange(len(u))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def join() -> np.ndarray:
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            links[:] += np.bincount(a, weights=copies[b], minlength=len(u)) + np.bincount(b, weights=copies[a], minlength=len(u))
            return _forest(len(u), label[place[a]], label[place[b]])[label]

        n_held = 0
        for a, b in _compare(u[left], u[right], same_block, r, half, need, cosine, reach):
            if len(a):
                held.append((left[a], right[b]))
                n_held += len(a)
            if n_held >= EDGES:
                label, n_held = join(), 0
        if held:
            label = join()
        root = reps[rank[label[place]]]
        hit = links > 0
        return pa.table([pa.array(reps[hit]), pa.array(root[hit]), pa.array(links[hit].astype(np.int64))], names=["rep", "root", "links"])

    return count


def near_classes(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", cosine: float = 0.9, m: int = DIRECTIONS,
                 window: float = WINDOW, missed: float = MISSED, block: int | None = None, seed: int = 2) -> DataFrame:
    """(key, n_links, component_id) per row: links to other rows with cosine >= ``cosine``, and the smallest key reachable.

    Cosines are computed in double precision. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing (0 links, their own component), as do rows with a null key (null component). Vectors of
    different lengths never link. Equal vectors are one vertex with a number of copies, so groups of
    copies are not paired; groups of near copies are counted block by block and only sums and a
    spanning forest leave a task. Rows that repeat a key count as rows. An empty table gives an empty result. ``block`` sets the vectors of a block.
    """
    spread = math.sqrt(2 - 2 * cosine)
    need = required_collisions(m, window, missed)
    rows = stored(vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v")), "vectors")
    fine = rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    kind = rows.schema["id"].dataType.simpleString()
    narrow = dict(vectors.dtypes)[vec] == "array<float>"  # what is copied keeps the input's width
    # One vertex per distinct vector; the vector's hash and smallest id name it.
    same = stored(fine.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column("v"))
                r = made.setdefault(int(dim), directions(int(dim), m, seed))
                own = x.astype(np.float32 if narrow else np.float64).reshape(-1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * int(dim)), pa.array(own))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), pa.array(np.full(len(x), dim, np.int32)), pa.array(_unit(x) @ r[0]), flat],
                                                 names=["rep", "copies", "dim", "p", "v"])

    points = stored(same.mapInArrow(project, f"rep {kind}, copies long, dim int, p double, v array<{'float' if narrow else 'double'}>"), "points")
    found = []
    for dim, n in points.groupBy("dim").count().collect():  # one row per vector length in use
        cuts = _cuts(n, int(dim), 4 if narrow else 8, points.sparkSession.sparkContext.defaultParallelism, block)
        own = points.where(F.col("dim") == dim)
        edges = sorted(set(own.approxQuantile("p", [i / cuts for i in range(1, cuts)], 0.1 / cuts))) if cuts > 1 else []
        cuts = len(edges) + 1
        r = directions(int(dim), m, seed)
        reach = spread * float(np.linalg.norm(r[0])) * (1 + 1e-9)
        # Block i holds values from edges[i-1] to edges[i]; it meets the blocks up to the one its upper edge can reach.
        last = np.append(np.searchsorted(edges, np.array(edges) + reach, side="right"), cuts - 1).tolist()
        first = np.searchsorted(last, np.arange(cuts)).tolist()
        spark = own.sparkSession
        table = spark.createDataFrame([(i, first[i], last[i]) for i in range(cuts)], "block int, low int, high int")
        cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="p", outputCol="at") if edges else None
        placed = (cut.transform(own).withColumn("block", F.col("at").cast("int")) if cut else own.withColumn("block", F.lit(0))).join(table, "block")
        met = placed.select("rep", "copies", "v", "block", F.explode(F.sequence("low", "high")).alias("other"))
        met = met.select("rep", "copies", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        half = window * spread / math.sqrt(dim)

        found.append(met.groupBy("i", "j").applyInArrow(_counter(r, half, need, cosine, reach), f"rep {kind}, root {kind}, links long"))
    base = rows.select("id", "v", (F.col("id").isNotNull() & _usable(F.col("v"))).alias("fine")).withColumn("v", F.when(F.col("fine"), F.transform("v", lambda x: x + F.lit(0.0))))
    if not found:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = stored(links, "vector-links")
    sums = links.groupBy("rep").agg(F.sum("links").alias("links"))
    root = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    named = same.join(sums, "rep", "left").join(root, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = base.join(named, "v", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
