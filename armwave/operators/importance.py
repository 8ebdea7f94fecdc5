"""Permutation importance of tree ensembles (Spark's, or forests of :mod:`growing`) by sets of leaves: no vector is copied per feature.

Every feature of a tree maps a value to the set of leaves that the tree's tests on this feature leave open. The first leaf in the
intersection of all features' sets is where a row ends. A shuffled feature exchanges one factor, so the sets of the
other features are intersected once per row and tree, and what the trees without the feature say is reused.

Trees only see between which thresholds of the model a value lies (or which category it is). Rows are coded so before they are shuffled, and
of the rows that a task holds, those of equal codes meet the trees once, as do equal pairs of a row's codes and the partner's code of a feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwave.operators.growing import Nodes
from armwave.operators.ordering import row_index
from armwave.session import cut_lineage, scratch_path

WORDS = 1 << 21  # 64-bit words of leaf sets that a task holds at a time
HELD = 1 << 19   # rows that a task compares at a time
_PARTIAL = "repeat int, feature int, n long, se double"
_PARTIAL_ARROW = pa.schema([("repeat", pa.int32()), ("feature", pa.int32()), ("n", pa.int64()), ("se", pa.float64())])


def set_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the first flag in the lowest bit of the first word."""
    words = -(-flags.shape[1] // 64)
    wide = np.zeros((len(flags), words * 64), np.uint8)
    wide[:, :flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def first_set(sets: np.ndarray) -> np.ndarray:
    """Number of the lowest bit that is set in each row of words; no row is empty."""
    word = (sets != 0).argmax(axis=1)
    m = sets[np.arange(len(sets)), word]
    lowest = m & (~m + np.uint64(1))
    return word * 64 + np.frexp(lowest.astype(np.float64))[1] - 1


@dataclass
class Cuts:
    """Leaf sets of a numeric feature: row i of ``open`` holds if i of the sorted thresholds are below the value."""

    thresholds: np.ndarray
    open: np.ndarray

    def sets(self, x: np.ndarray) -> np.ndarray:
        return self.open[np.searchsorted(self.thresholds, x, side="left")]


@dataclass
class Codes:
    """Leaf sets of a categorical feature: one row per category, the last row for all other values."""

    open: np.ndarray

    def sets(self, x: np.ndarray) -> np.ndarray:
        last = len(self.open) - 1
        known = (x >= 0) & (x < last) & (x == np.floor(x))
        return self.open[np.where(known, x, last).astype(np.int64)]


@dataclass
class Tree:
    weight: float
    values: np.ndarray
    features: dict[int, Cuts | Codes]

    @property
    def words(self) -> int:
        return -(-len(self.values) // 64)


def leaf_sets(nodes: pd.DataFrame, weight: float) -> Tree:
    """A tree from its stored nodes, which are numbered in preorder: a left subtree is a run of numbers, and leaves keep their order."""
    nodes = nodes.sort_values("id")
    ends = nodes.left.to_numpy() < 0
    leaves, inner = nodes.id.to_numpy()[ends], nodes[~ends]
    features: dict[int, Cuts | Codes] = {}
    for f, own in inner.groupby("feature"):
        lost = (leaves >= own.left.to_numpy()[:, None]) & (leaves < own.right.to_numpy()[:, None])  # by going right
        k = int(own.categories.iloc[0])
        if k < 0:
            features[int(f)] = _cut_sets(np.array([v[0] for v in own.test]), lost)
        else:
            gone = np.zeros((k + 1, len(leaves)), bool)
            for test, left_leaves in zip(own.test, lost):
                right = np.ones(k + 1, bool)
                right[np.asarray(test, np.int64)] = False
                right[k] = len(test) <= k // 2  # a value that is no category goes to the side that lists more of them
                gone |= right[:, None] & left_leaves
            features[int(f)] = Codes(set_bits(~gone))
    return Tree(weight, nodes.prediction.to_numpy()[ends], features)


def _cut_sets(t: np.ndarray, lost: np.ndarray) -> Cuts:
    """Leaf sets from thresholds and the leaves that going right at each of them loses."""
    order = np.argsort(t, kind="stable")
    gone = np.logical_or.accumulate(lost[order], axis=0)
    return Cuts(t[order], set_bits(~np.vstack([np.zeros((1, lost.shape[1]), bool), gone])))


def stored_trees(spark: SparkSession, model: Model) -> list[Tree]:
    """Leaf sets of a fitted tree, forest or boosted model, read from its stored form (one row per node)."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if isinstance(model, DecisionTreeRegressionModel):
        rows, weights = rows.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData")), [1.0]
    elif isinstance(model, RandomForestRegressionModel):
        weights = [1.0 / model.getNumTrees] * model.getNumTrees
    else:
        weights = list(model.treeWeights)
    at = "nodeData."
    nodes = rows.select("treeID", f"{at}id", f"{at}prediction", F.col(f"{at}leftChild").alias("left"), F.col(f"{at}rightChild").alias("right"), F.col(f"{at}split.featureIndex").alias("feature"),
                        F.col(f"{at}split.leftCategoriesOrThreshold").alias("test"), F.col(f"{at}split.numCategories").alias("categories")).toArrow().to_pandas()  # the nodes of one model
    return [leaf_sets(own, weights[int(t)]) for t, own in nodes.groupby("treeID")]


def grown_trees(trees: Sequence[Nodes], cuts: Sequence[np.ndarray]) -> list[Tree]:
    """Leaf sets of a grown forest; ``cuts`` are the upper ends of the bins of every feature (``growing.Table.cuts``)."""
    made = []
    for t in trees:
        order, rest = [], [0]
        while rest:  # preorder
            n = rest.pop()
            order.append(n)
            if t.feature[n] >= 0:
                rest += [int(t.right[n]), int(t.left[n])]
        number = np.full(len(t.feature), -1)
        number[order] = np.arange(len(order))
        own = np.array(order)
        ends = t.feature[own] < 0
        leaves, inner = number[own[ends]], own[~ends]
        lost = (leaves >= number[t.left[inner]][:, None]) & (leaves < number[t.right[inner]][:, None])  # by going right
        tested = t.feature[inner]
        features = {int(f): _cut_sets(cuts[f][t.cut[inner[tested == f]]], lost[tested == f]) for f in np.unique(tested)}
        made.append(Tree(1.0 / len(trees), t.value[own[ends]], features))
    return made


def predictions(trees: list[Tree] | Coded, x: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Predictions of the rows (of values or codes), and per feature that any tree tests those with the partner's value in its place.

    Rows of equal codes meet the trees once, and so do rows of equal codes whose partners have the same code of the feature.
    """
    coded = Coded(trees) if isinstance(trees, list) else trees
    x, partner = (v if v.dtype == np.uint16 else coded.of(v) for v in (x, partner))
    distinct, of = coded.numbers(x)
    pairs, moves = [], []
    for at in range(len(coded.slots)):
        pair, which = _numbered(of * coded.sizes[at] + partner[:, at], len(distinct) * coded.sizes[at])
        was, new = np.divmod(pair, coded.sizes[at])
        moved = np.flatnonzero(distinct[was, at] != new)
        pairs.append((was, moved, which))
        moves.append((was[moved], new[moved]))
    total, again = coded.predictions(distinct, moves)
    changed = {}
    for f, (was, moved, which), own in zip(coded.slots, pairs, again):
        values = total[was]
        values[moved] = own
        changed[f] = values[which]
    return total[of], changed


def _numbered(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of numbers below ``most``, which of them each one is), without sorting if a table of all numbers is not much longer."""
    if most > 4 * len(x):
        values, which = np.unique(x, return_inverse=True)
        return values, which.ravel()
    seen = np.zeros(most, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


class Coded:
    """The trees over codes: for every feature that they test, the number of the model's thresholds below a value, or its category."""

    def __init__(self, trees: list[Tree]) -> None:
        self.slots = sorted({f for t in trees for f in t.features})
        self.plain = sum(t.weight * t.values[0] for t in trees if not t.features)
        self.limits: list[np.ndarray | int] = []
        for f in self.slots:
            tables = [t.features[f] for t in trees if f in t.features]
            self.limits.append(np.unique(np.concatenate([c.thresholds for c in tables])) if hasattr(tables[0], "thresholds") else max(len(c.open) for c in tables) - 1)
        # one value for every code; the last category stands for all others
        stands = [np.append(m, np.inf) if isinstance(m, np.ndarray) else np.append(np.arange(m), -1.0) for m in self.limits]
        self.sizes = [len(v) for v in stands]
        self.trees = [(t, [(self.slots.index(f), table.sets(stands[self.slots.index(f)])) for f, table in t.features.items()]) for t in trees if t.features]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x tested features) of rows of values."""
        out = np.empty((len(x), len(self.slots)), np.uint16)
        for i, (f, limits) in enumerate(zip(self.slots, self.limits)):
            if isinstance(limits, np.ndarray):
                out[:, i] = np.searchsorted(limits, x[:, f], side="left")
            else:
                known = (x[:, f] >= 0) & (x[:, f] < limits) & (x[:, f] == np.floor(x[:, f]))
                out[:, i] = np.where(known, x[:, f], limits)
        return out

    def numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct rows of codes, which of them each row is)."""
        if not len(codes):
            return codes, np.zeros(0, np.int64)
        whole, count = np.zeros(len(codes), np.int64), 1
        for i, size in enumerate(self.sizes):
            if count * size >= 1 << 62:  # numbered anew before they overflow
                whole = pd.factorize(whole)[0]
                count = int(whole.max()) + 1
            whole, count = whole * size + codes[:, i], count * size
        of = pd.factorize(whole)[0]
        first = np.empty(int(of.max()) + 1, np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        return codes[first], of

    def _parts(self, words: int, n: int, more: int) -> Iterator[slice]:
        step = max(1, WORDS // (words * more))
        return (slice(a, a + step) for a in range(0, n, step))

    def predictions(self, codes: np.ndarray, moves: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Predictions of rows of codes, and per slot those of its moves (row, in order, and the code that replaces the slot's).

        A tree's sets of all features but one are intersected once per row: a move costs one more set, however many features there are.
        """
        out, moved = np.full(len(codes), float(self.plain)), [np.full(len(row), float(self.plain)) for row, _ in moves]
        for t, tables in self.trees:
            at = {i: k for k, (i, _) in enumerate(tables)}
            for part in self._parts(t.words, len(codes), 2 * len(tables) + 3):
                sets = [table[codes[part, i]] for i, table in tables]
                others: list[np.ndarray | None] = [None]
                for own in sets[:-1]:
                    others.append(own if others[-1] is None else others[-1] & own)
                whole = sets[-1]
                for k in range(len(sets) - 2, -1, -1):
                    others[k] = whole if others[k] is None else others[k] & whole
                    whole = whole & sets[k]
                plain = t.weight * t.values[first_set(whole)]
                out[part] += plain
                for i, (row, new) in enumerate(moves):
                    a, b = np.searchsorted(row, [part.start, part.start + len(plain)]).tolist()
                    if i not in at:
                        moved[i][a:b] += plain[row[a:b] - part.start]
                        continue
                    table, rest = tables[at[i]][1], others[at[i]]
                    for some in self._parts(t.words, b - a, 3):
                        own = table[new[a:b][some]]
                        if rest is not None:
                            own &= rest[row[a:b][some] - part.start]
                        moved[i][a:b][some] += t.weight * t.values[first_set(own)]
        return out, moved


def _error_sums(trees: list[Tree], n_features: int, repeats: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task: error sums by feature and repeat, of rows of values (arrays) or of codes (bytes)."""
    coded = Coded(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, se = np.zeros(repeats, np.int64), np.zeros((n_features + 1, repeats))  # the last line: nothing shuffled
        held: list[tuple[np.ndarray, ...]] = []

        def meet() -> None:
            r, y, x, p = (np.concatenate(c) for c in zip(*held))
            held.clear()
            sums = lambda v: np.bincount(r, (y - v) ** 2, repeats)
            total, changed = predictions(coded, x, p)
            n[:] += np.bincount(r, minlength=repeats)
            plain = sums(total)
            for f in range(n_features):
                se[f] += sums(changed[f]) if f in changed else plain
            se[n_features] += plain

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("repeat").to_numpy(), b.column("_y").to_numpy(), *(_codes(b.column(c), coded) for c in ("_x", "_p"))))
            if sum(len(h[0]) for h in held) >= HELD:
                meet()
        if held:
            meet()
        seen = np.flatnonzero(n)
        f, k = (a.ravel() for a in np.meshgrid(np.arange(n_features + 1), seen, indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(n[k]), pa.array(se[f, k])], schema=_PARTIAL_ARROW)

    return run


def _codes(column: pa.Array, coded: Coded) -> np.ndarray:
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), len(coded.slots))
    return coded.of(column.flatten().to_numpy().reshape(len(column), -1))


def shuffled_drop(df: DataFrame, model: Model | list[Tree], n_features: int, key: str, label: str = "label", features: str = "features",
                  repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance, sd): R2 drop per feature when it is shuffled over the given rows, mean and SD over repeats.

    In every repeat each row meets one partner (a shuffled position), so ``repeats`` times the rows are shuffled, however many features
    there are; tasks return sums per (feature, repeat). Features that no tree tests have 0. Rows without label or features take no
    part; without rows the table is empty, and with equal labels the importance is null. ``key`` is unique. ``model`` is a model of Spark or
    the trees themselves. Its nodes are read by the driver: a tree of L leaves takes at most L * L / 8 bytes, which suits trees of some thousand leaves.
    """
    trees = df.sparkSession.sparkContext.broadcast(stored_trees(df.sparkSession, model) if isinstance(model, Model) else model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Coded(trees.value)
        for b in batches:
            codes = [c.tobytes() for c in _codes(b.column("_x"), coded)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_y"), pa.array(codes, pa.binary())], names=["_k", "_y", "_x"])

    rows = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(key).alias("_k"), F.col(label).cast("double").alias("_y"), vector_to_array(features).alias("_x"))
    base = cut_lineage(rows.mapInArrow(code, f"_k {dict(rows.dtypes)['_k']}, _y double, _x binary"))
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    at = row_index(base, "_k", "_k", "_at").select(every, "_at", "_y", "_x")
    mixed = base.select(every, "_k", F.col("_x").alias("_p")).withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), F.col("repeat"), F.col("_k")), F.lit(1 << 50)))
    partner = row_index(mixed, "_h", "_k", "_at", ["repeat"]).select("repeat", "_at", "_p")
    met = at.join(partner, ["repeat", "_at"]).select("repeat", "_y", "_x", "_p")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _error_sums(trees.value, n_features, repeats)(batches)

    errors = met.mapInArrow(sums, _PARTIAL).groupBy("feature", "repeat").agg((F.sum("se") / F.sum("n")).alias("mse"))
    plain = errors.where(F.col("feature") == n_features).select("repeat", F.col("mse").alias("_mse"))
    spread = base.agg(F.var_pop("_y").alias("_v")).withColumn("_one", F.lit(0))
    drops = errors.where(F.col("feature") < n_features).join(plain, "repeat").withColumn("_one", F.lit(0)).join(F.broadcast(spread), "_one")
    drop = F.try_divide(F.col("mse") - F.col("_mse"), F.col("_v"))
    return drops.groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("sd"))
