"""Hard negatives by Fagin's threshold algorithm on sorted lists of vector components.

Candidates are cut into blocks in the order of their label. A block holds one list per dimension, its rows in descending order of
that component. An anchor reads a list from the top where its own component is not negative, from the bottom
elsewhere, so that on every list the rows come in descending order of their share in the score. Rows that turn up on any
list are scored by random access, in integers. The threshold, the sum of the shares last read, bounds the score of
every row not seen yet; an anchor leaves a block once its threshold is strictly below the lowest score that could still enter
one of its windows: the kth score of a full window (ties may still be decided by the smaller id), the lower end of another.

The first pass has one open window per anchor and finds its positives among rows of its label, the second has a window per positive and
finds negatives among the other labels. Anchors in groups meet runs of blocks ("cells"); a task streams the
blocks past one group, so it holds one group and one block, and a cell hands on at most k rows a window. The number of cells
follows the product of anchors and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwave.llm.graph import dropped, stored
from armwave.operators.ordering import row_index

SCALE = 256
BLOCK = 2048            # candidates of a block
GROUP = 4096            # anchors that a task holds at once
CELL_PAIRS = 1 << 32    # anchors x candidates of a task
DEPTHS = (16, 64, 192, 512)
_EXACT = 1 << 53


def _usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False))


def scaled(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles that hold integers."""
    return np.floor(scale * x.astype(np.float64))


def _small(x: np.ndarray) -> bytes:
    """Integers in the smallest of three widths; the width follows from the number of bytes."""
    top = float(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64).tobytes()


def _large(data: bytes, n: int, dim: int) -> np.ndarray:
    width = len(data) // (n * dim)
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.float64}[width]).reshape(n, dim).astype(np.float64)


class Block:
    """Candidates of one block with their sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, order: np.ndarray) -> None:
        self.ids, self.labels, self.x, self.order = ids, labels, x, order
        self.sorted = np.take_along_axis(np.ascontiguousarray(x.T), order.astype(np.int64), axis=1)
        self.kinds = set(labels.tolist())


class Search:
    """Anchors with their windows, and the best rows of each window so far.

    ``low`` and ``high`` (anchors x windows) bound the scores of a window, both included; a window whose low end is above its high end is
    closed. ``same`` looks among rows of the anchor's label with another id, else among the other labels.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.a, self.k, self.same = ids, labels, a, k, same
        self.high, self.bar = high, np.where(low <= high, low, np.inf)  # a closed window has an infinite bar
        self.top: list[list[list[tuple]]] = [[[] for _ in range(high.shape[1])] for _ in ids]
        self.seen = self.met = 0

    def _applies(self, b: Block) -> np.ndarray:
        open_ = self.bar.min(axis=1) != np.inf
        if self.same:
            return open_ & np.fromiter((x in b.kinds for x in self.labels), bool, len(self.labels))
        if len(b.kinds) == 1:
            return open_ & (self.labels != next(iter(b.kinds)))
        return open_

    def _widen(self) -> None:
        """Bars and ends as Python numbers, which stay whole beyond 2^53."""
        if self.bar.dtype != object:
            whole = np.frompyfunc(lambda v: int(v) if abs(v) != np.inf else v, 1, 1)
            self.bar, self.high = whole(self.bar), whole(self.high)

    def visit(self, b: Block) -> None:
        """Sorted access to the lists of one block until every anchor's threshold is below its bars."""
        at = np.flatnonzero(self._applies(b))
        if not len(at):
            return
        a, x, values, m = self.a[at], b.x, b.sorted, len(b.ids)
        self.met += len(at) * m
        if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] >= _EXACT:  # beyond doubles: whole numbers of any size
            exact = np.frompyfunc(int, 1, 1)
            a, x, values = exact(a), exact(x), exact(values)
            self._widen()
        up = self.a[at] >= 0
        ahead, behind = np.where(up, a, 0), np.where(up, 0, a)
        seen = np.zeros((len(at), m), bool)
        depths = [0, *[d for d in DEPTHS if d < m], m]
        for done, depth in zip(depths, depths[1:]):
            threshold = ahead @ values[:, max(done, 1) - 1] + behind @ values[:, m - max(done, 1)]
            live = np.flatnonzero(~(threshold < self.bar[at].min(axis=1)) & ~seen.all(axis=1))
            if not len(live):
                break
            new = np.zeros((len(live), m), bool)
            for d in range(x.shape[1]):
                new[np.ix_(up[live, d], b.order[d, done:depth])] = True
                new[np.ix_(~up[live, d], b.order[d, m - depth: m - done])] = True
            new &= ~seen[live]
            seen[live] |= new
            self.seen += int(new.sum())
            rows = np.flatnonzero(new.any(axis=0))
            self._score(at[live], a[live] @ x[rows].T, new[:, rows], b.ids[rows], b.labels[rows])

    def _score(self, at: np.ndarray, score: np.ndarray, new: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = new & (score >= self.bar[at].min(axis=1)[:, None]) & (score <= self.high[at].max(axis=1)[:, None])
        for i in np.flatnonzero(fits.any(axis=1)):
            j = np.flatnonzero(fits[i])
            own = labels[j] == self.labels[at[i]]
            j = j[own & (ids[j] != self.ids[at[i]])] if self.same else j[~own]
            s = score[i, j]
            order = np.lexsort((ids[j], -s))
            s, found = s[order], ids[j][order]
            for w, best in enumerate(self.top[at[i]]):
                hit = np.flatnonzero((s >= self.bar[at[i], w]) & (s <= self.high[at[i], w]))[: self.k]
                if len(hit):
                    best[:] = sorted([*best, *((-int(s[h]), int(found[h])) for h in hit)])[: self.k]
                    if len(best) == self.k:
                        self.bar[at[i], w] = -best[-1][0]

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(anchor, window, score, id) of all rows in windows."""
        for i, windows in enumerate(self.top):
            for w, best in enumerate(windows):
                for s, found in best:
                    yield i, w, max(min(-s, (1 << 63) - 1), -(1 << 63)), found


def _strings(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _packer(scale: float, lists: bool):
    """Rows of one block or group as one row: ids, labels, components, and (of a block) the rows in order of each component."""

    def pack(t: pa.Table) -> pa.Table:
        x = scaled(_matrix(t.column("v")), scale)
        order = np.argsort(-x, axis=0, kind="stable").T.astype(np.uint16).tobytes() if lists else None
        one = {"dim": [x.shape[1]], "at": [t.column("at")[0].as_py()], "ids": [t.column("id").to_numpy().tobytes()], "labels": [t.column("label").to_pylist()],
               "x": [_small(x)], "lists": [order], "pos": [t.column("pos").to_numpy().tobytes()], "windows": [t.column("windows").to_pylist()]}
        return pa.table({"dim": pa.array(one["dim"], pa.int32()), "at": pa.array(one["at"], pa.int64()), "ids": pa.array(one["ids"], pa.binary()), "labels": pa.array(one["labels"], pa.list_(pa.string())),
                         "x": pa.array(one["x"], pa.binary()), "lists": pa.array(one["lists"], pa.binary()), "pos": pa.array(one["pos"], pa.binary()),
                         "windows": pa.array(one["windows"], pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))})

    return pack


_PACKED = "dim int, at long, ids binary, labels array<string>, x binary, lists binary, pos binary, windows array<array<struct<id:long,score:long>>>"


def _searcher(k: int, low_share: int, high_share: int, same: bool):
    """Task: packed rows in the order (cell, anchors before blocks); blocks stream past the anchors of their cell."""

    def begin(row: dict) -> tuple[Search, np.ndarray, list]:
        ids, pos = (np.frombuffer(row[c], np.int64) for c in ("ids", "pos"))
        a = _large(row["x"], len(ids), row["dim"])
        windows = [w or [] for w in row["windows"]]
        n = 1 if same else max(map(len, windows), default=0) or 1
        large = any(abs(p["score"]) >= _EXACT for own in windows for p in own)
        low, high = (np.full((len(ids), n), end if same else -end, dtype=object if large else float) for end in (-np.inf, np.inf))
        for i, own in enumerate(windows):
            for w, positive in enumerate(own):  # low_share * p <= 100 * s <= high_share * p
                low[i, w], high[i, w] = -(-low_share * positive["score"] // 100), high_share * positive["score"] // 100
        return Search(ids, np.array(row["labels"], dtype=object), a, low, high, k, same), pos, windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state = None, None

        def result() -> pa.RecordBatch:
            search, pos, windows = state
            found = list(search.rows())
            p = [windows[i][w] if not same else {"id": None, "score": None} for i, w, _, _ in found]
            return pa.RecordBatch.from_arrays([
                pa.array([int(pos[i]) for i, _, _, _ in found], pa.int64()), pa.array([search.a.shape[1]] * len(found), pa.int32()), pa.array([int(search.ids[i]) for i, _, _, _ in found], pa.int64()),
                pa.array([w for _, w, _, _ in found], pa.int32()), pa.array([x["id"] for x in p], pa.int64()), pa.array([x["score"] for x in p], pa.int64()),
                pa.array([s for _, _, s, _ in found], pa.int64()), pa.array([f for _, _, _, f in found], pa.int64())],
                names=["pos", "dim", "anchor_id", "w", "positive_id", "positive_score", "score", "id"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["dim"], row["grp"], row["chunk"]) != cell:
                    if state is not None:
                        yield result()
                    cell, state = (row["dim"], row["grp"], row["chunk"]), None
                if row["lists"] is None:
                    state = begin(row)
                elif state is not None:
                    ids = np.frombuffer(row["ids"], np.int64)
                    order = np.frombuffer(row["lists"], np.uint16).reshape(row["dim"], len(ids))
                    state[0].visit(Block(ids, np.array(row["labels"], dtype=object), _large(row["x"], len(ids), row["dim"]), order))
        if state is not None:
            yield result()

    return run


_FOUND = "pos long, dim int, anchor_id long, w int, positive_id long, positive_score long, score long, id long"


def _cells(spark, blocks: DataFrame, groups: DataFrame, cell_pairs: int, same: bool) -> DataFrame:
    """Blocks and anchor groups dealt to cells, one group and one run of blocks each; anchors come first in a cell."""
    shape = blocks.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("labels")).alias("rows"))
    own = groups.groupBy("dim").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("labels")).alias("anchors"))
    least = 2 * spark.sparkContext.defaultParallelism
    want = F.greatest(F.lit(least), F.ceil(F.col("rows") * F.col("anchors") / cell_pairs))
    plan = shape.join(own, "dim").select("dim", "blocks", "groups", F.least(F.col("blocks"), F.ceil(want / F.col("groups"))).cast("long").alias("chunks"))
    tasks = sum(r.groups * r.chunks for r in plan.collect())  # one row per vector length in use
    columns = [F.col(c.split()[0]) for c in _PACKED.split(", ")]
    placed = blocks.join(F.broadcast(plan), "dim").withColumn("chunk", F.floor(F.col("at") * F.col("chunks") / F.col("blocks")).cast("long"))
    met = placed.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    if same:  # only groups that share a label with the block; both are runs in the order of labels
        ends = groups.select("dim", F.col("at").alias("grp"), F.array_min("labels").alias("lo"), F.array_max("labels").alias("hi"))
        met = met.join(ends, ["dim", "grp"]).where((F.col("lo") <= F.array_max("labels")) & (F.array_min("labels") <= F.col("hi")))
    asked = groups.join(F.broadcast(plan), "dim").withColumn("grp", F.col("at")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    both = met.select(*columns, "grp", "chunk").unionByName(asked.select(*columns, "grp", "chunk"))
    return both.repartition(max(1, int(tasks)), "dim", "grp", "chunk").sortWithinPartitions("dim", "grp", "chunk", F.col("lists").isNotNull(), "at")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of every window over all cells, which gave at most k each."""
    order = Window.partitionBy("dim", "pos", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, vec: str = "embedding", key: str = "vec_id", label: str | Column = "label", positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100, scale: float = SCALE, block: int = BLOCK, group: int = GROUP, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows where ``anchor`` is true.

    A score is the inner product of floor(scale * component). Higher scores come first, ties by the smaller key. An anchor's positives are its
    first ``positives`` rows of its label with another key; for each, its first ``negatives`` rows of other labels with
    low% <= negative_score / positive_score <= high% (as integers: low * p <= 100 * s <= high * p). A positive with no such row gives none.

    Rows take no part if key, label or vector is null, the vector is empty, or a component is null or not finite. Vectors of another
    length than the anchor's never meet it. Rows that repeat a key are rows; equal ones give equal results. Scores that do
    not fit 64 bits are held at the ends of the range. Keys are whole numbers, labels of any type that casts to text.
    """
    spark = vectors.sparkSession
    name = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), name.cast("string").alias("label"), F.col(f"`{vec}`").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    placed = stored(row_index(rows, "label", "id", "pos", ["dim"]), "candidates")
    blocks = placed.withColumns({"at": F.floor(F.col("pos") / block).cast("long"), "windows": none}).groupBy("dim", "at").applyInArrow(_packer(scale, True), _PACKED)
    blocks = stored(blocks, "blocks")
    anchors = stored(row_index(placed.where("asks").drop("pos"), "label", "id", "pos", ["dim"]).withColumn("at", F.floor(F.col("pos") / group).cast("long")), "anchors")

    groups = stored(anchors.withColumn("windows", none).groupBy("dim", "at").applyInArrow(_packer(scale, False), _PACKED), "groups")
    if groups.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = _cells(spark, blocks, groups, cell_pairs, True).mapInArrow(_searcher(positives, low, high, True), _FOUND)
    first = _best(found, positives).groupBy("dim", "pos").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    first = first.select("dim", "pos", F.transform("best", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("windows"))
    armed = stored(anchors.join(first, ["dim", "pos"]).groupBy("dim", "at").applyInArrow(_packer(scale, False), _PACKED), "groups")
    numbered = armed if armed.isEmpty() else _dense(armed)
    found = stored(_cells(spark, blocks, numbered, cell_pairs, False).mapInArrow(_searcher(negatives, low, high, False), _FOUND), "negatives")
    for table in (placed, blocks, anchors, groups, armed):
        dropped(table)
    return _best(found, negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _dense(groups: DataFrame) -> DataFrame:
    """Groups numbered without gaps per vector length: a group whose anchors all lack positives is gone."""
    places = Window.partitionBy("dim").orderBy("at")
    number = groups.select("dim", "at").withColumn("now", (F.row_number().over(places) - 1).cast("long"))  # one row per group
    return groups.join(F.broadcast(number), ["dim", "at"]).withColumn("at", F.col("now")).drop("now")
