"""Item text and vectors: encoding, cosine matching, projection and density clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.operators.blocks import block_pairs
from armwave.session import cut_lineage


def embed(df: DataFrame, col: str, out: str = "vector", size: int = 256, encoder: Callable | None = None) -> DataFrame:
    """Text to vector. Default: hashed word weights (tf-idf), unit length.

    ``encoder`` may be any function from a list of texts to a matrix; it runs on Arrow batches.
    """
    if encoder is not None:
        @F.pandas_udf("array<double>")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(v) for v in row] for row in encoder(texts.fillna("").tolist())])

        return df.withColumn(out, encode(F.col(col)))
    stages = [
        RegexTokenizer(inputCol=col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit("")))
    done = Pipeline(stages=stages).fit(filled).transform(filled)
    return done.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_idf", "_unit")


TILE_BYTES = 64 << 20  # of the similarities a task holds at once
PLACE_BYTES = 16 << 20  # of the distances a task of the density clusters holds at once
BLOCK_ROWS = 8192       # points of a block that meets others


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype("float64")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _against(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec: str, keep: int | None, min_sim: float | None, max_bytes: int) -> DataFrame:
    """Similarities of each a row to the b rows; with ``keep``, the best per a row and block of b.

    If b fits ``max_bytes`` it is broadcast and a is not shuffled; otherwise both sides are cut
    into blocks and compared on the cluster.
    """
    types = dict(a.dtypes)[a_id], dict(b.dtypes)[b_id]
    schema = f"a_id {types[0]}, b_id {types[1]}, similarity double"

    def side(df, key):
        return df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())

    left, right = side(a, a_id), side(b, b_id)

    def score(own, x, ids, m):
        """Both sides as unit rows; ids in order, so the first of equal values has the smallest id."""
        sims = x @ m.T
        if keep is None:
            i, j = np.nonzero(np.ones_like(sims, dtype=bool) if min_sim is None else sims >= min_sim)
        elif keep == 1:
            i, j = np.arange(len(own)), sims.argmax(axis=1)
        else:
            best = np.argsort(-sims, axis=1, kind="stable")[:, :keep]  # stable: of equal values the smallest id
            i, j = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
        return pd.DataFrame({"a_id": own[i], "b_id": ids[j], "similarity": sims[i, j]})

    size = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return left.select(F.col("id").alias("a_id"), F.lit(None).cast(types[1]).alias("b_id"), F.lit(0.0).alias("similarity")).limit(0)
    if size["n"] * size["d"] * 8 <= max_bytes:
        small = right.orderBy("id").toPandas()
        shared = a.sparkSession.sparkContext.broadcast((small["id"].to_numpy(), _unit(small["v"])))

        def score_batches(batches):
            ids, m = shared.value
            for batch in batches:
                for at in range(0, len(batch), max(1, TILE_BYTES // (8 * len(ids)))):
                    part = batch.iloc[at: at + max(1, TILE_BYTES // (8 * len(ids)))]
                    yield score(part["id"].to_numpy(), _unit(part["v"]), ids, m)

        return left.mapInPandas(score_batches, schema)

    def score_blocks(x, y):
        if not len(x) or not len(y):
            return pd.DataFrame({"a_id": [], "b_id": [], "similarity": []})
        y = y.sort_values("o_id")
        own, ids, m = x["id"].to_numpy(), y["o_id"].to_numpy(), _unit(y["o_v"])
        step = max(1, TILE_BYTES // (8 * len(ids)))
        return pd.concat([score(own[at: at + step], _unit(x["v"].iloc[at: at + step]), ids, m) for at in range(0, len(own), step)], ignore_index=True)

    # max_bytes is the limit of a broadcast; a block is as large as a task may hold, since every block travels to all blocks of the other side
    every = keep is None and min_sim is None  # all pairs of two blocks leave the task
    rows = min(math.isqrt(TILE_BYTES // 8) if every else BLOCK_ROWS, max(1, TILE_BYTES // (8 * max(1, size["d"]))))
    return block_pairs(left.withColumn("cell", F.lit(0)), right.withColumn("cell", F.lit(0)), "cell", ["id"], ["id"],
                       score_blocks, schema, rows, rows)


def cosine_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec: str = "vector", min_sim: float | None = None,
                 max_bytes: int = 64 << 20) -> DataFrame:
    """Cosine similarity of every a row with every b row (the result is the full matrix by definition).

    A small b is shared with the tasks, so a is not shuffled; a large one is compared in blocks.
    With ``min_sim`` only the pairs at or above it leave a task.
    """
    return _against(a, b, a_id, b_id, vec, None, min_sim, max_bytes)


def best_match(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec: str = "vector", k: int = 1, max_bytes: int = 64 << 20) -> DataFrame:
    """The k most similar b rows of each a row, exact; ties go to the smallest id.

    Each task keeps k rows per a row and block of b, and a final aggregate merges the blocks.
    """
    near = _against(a, b, a_id, b_id, vec, k, None, max_bytes)
    packed = near.groupBy("a_id").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("similarity")).alias("_s"), F.col("b_id")))), 1, k).alias("best"))
    return packed.select("a_id", F.posexplode("best").alias("rank", "m")).select(
        "a_id", F.col("m.b_id").alias("b_id"), (-F.col("m._s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def best_pair(matches: DataFrame) -> DataFrame:
    """The single most similar pair."""
    return matches.orderBy(F.col("similarity").desc(), "a_id", "b_id").limit(1)


def project(df: DataFrame, vec: str, k: int = 2, out: str = "projected") -> DataFrame:
    """Principal components of the vectors (for tables: x, y, z columns are the array's elements)."""
    rows = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    done = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    return done.withColumn(out, vector_to_array("_p")).drop("_v", "_p")


# ---- density clusters ---------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) edges: (u, root) for every node that is not its own root.

    Alternates two rewiring rounds (large star, small star); each round is written to the shared
    folder, so lost executors cost nothing and plans stay short.
    """
    e = cut_lineage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = state(e)
        if now == seen:
            return e.select("u", F.col("v").alias("root"))
        seen = now


def _apart(centres: np.ndarray, eps: float) -> np.ndarray:
    """Pivots at least eps apart, so that one pile of near copies is one cell."""
    kept: list[int] = []
    for i in range(len(centres)):
        if not kept or ((centres[kept] - centres[i]) ** 2).sum(axis=1).min() > eps * eps:
            kept.append(i)
    return centres[kept]


def near_edges(points: DataFrame, eps: float, pivots: int | None = None) -> DataFrame:
    """(u, v) links that connect exactly the pairs within ``eps``; points = (id, v), without equal vectors.

    Every point has a home cell (its nearest pivot) and is not copied to others: cells are put into blocks, and two blocks meet in one task
    if the triangle inequality lets any of their cells hold points within eps. Points within eps/2 of their pivot are all within eps of
    each other; they are linked to one of them instead of being compared, so a dense pile stays linear.
    """
    n = points.count()
    if n == 0:
        return points.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    spark, kind = points.sparkSession, dict(points.dtypes)["id"]
    size = pivots or min(4096, max(8, int(math.sqrt(n))))
    picked = points.orderBy(F.xxhash64("id"), "id").limit(size).collect()  # at most 4096 vectors
    centres = _apart(np.array([r["v"] for r in picked], dtype="float64"), eps)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches):
        c = shared.value
        for batch in batches:
            for at in range(0, len(batch), max(1, PLACE_BYTES // (8 * len(c)))):
                part = batch.iloc[at: at + max(1, PLACE_BYTES // (8 * len(c)))]
                x = np.stack(part["v"].to_numpy()).astype("float64")
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0))
                home = d.argmin(axis=1)
                gap = d[np.arange(len(x)), home]
                # small slack: the shortcut distance formula loses a few digits
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "cell": home.astype("int32"), "gap": gap, "core": gap <= eps / 2 - 1e-6})

    cells = cut_lineage(points.mapInPandas(place, f"id {kind}, v array<double>, cell int, gap double, core boolean"))
    core = cells.where("core")
    hub = core.groupBy("cell").agg(F.min("id").alias("u"))
    star = core.join(hub, "cell").where(F.col("id") != F.col("u")).select("u", F.col("id").alias("v"))
    units = cells.groupBy("cell", "core").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # two per pivot
    rows = min(BLOCK_ROWS, max(1024, n // spark.sparkContext.defaultParallelism))
    return star.unionByName(_near_blocks(cells, units, centres, eps, rows)).distinct()


def _blocks(units: list, centres: np.ndarray, rows: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Units (cell, core or not) dealt to blocks of about ``rows`` rows in the order of the widest direction of the pivots.

    (cell, core, first block, number of blocks) of each unit, and unit, block and whether the block is one of several of a core, for every pair of unit and block.
    """
    mid = centres - centres.mean(axis=0)
    along = mid @ np.linalg.eigh(mid.T @ mid)[1][:, -1]
    dealt, block, filled, pairs = [], 0, 0, []
    for i in sorted(range(len(units)), key=lambda i: (along[units[i]["cell"]], units[i]["cell"], units[i]["core"])):
        u = units[i]
        if filled and filled + u["n"] > rows:
            block, filled = block + 1, 0
        parts = -(-u["n"] // rows)
        dealt.append((u["cell"], u["core"], block, parts))
        pairs += [(i, block + k, parts > 1 and u["core"]) for k in range(parts)]
        if parts > 1:
            block, filled = block + parts, 0
        else:
            filled += u["n"]
    unit, own, pile = (np.array(x) for x in zip(*pairs))
    return dealt, unit, own, pile


def _merged(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Smallest connected number of every node in place, after the links u - v."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _linked(ids: np.ndarray, x: np.ndarray, y: np.ndarray, x_pile: np.ndarray, y_pile: np.ndarray, eps: float, shift: int) -> pd.DataFrame:
    """A link to the first connected point for every point that is within ``eps`` of one of the other side; row j of y is point ``shift`` + j.

    Pairs of one pile (a number from 0 on) are not compared.
    """
    root, sq = np.arange(len(ids)), (y * y).sum(1)
    step = max(1, PLACE_BYTES // (8 * max(1, len(y))))
    for begin in range(0, len(x), step):
        part = x[begin: begin + step]
        i, j = np.nonzero((part * part).sum(1)[:, None] - 2 * part @ y.T + sq[None, :] <= eps * eps + 1e-6)
        i += begin
        fresh = (root[i] != root[j + shift]) & ((x_pile[i] < 0) | (x_pile[i] != y_pile[j]))
        i, j = i[fresh], j[fresh]
        for start in range(0, len(i), 65536):  # exact check of the candidates
            p, q = i[start: start + 65536], j[start: start + 65536]
            hit = ((x[p] - y[q]) ** 2).sum(1) <= eps * eps
            _merged(root, p[hit], q[hit] + shift)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"u": ids[root[linked]], "v": ids[linked]})


def _block_links(left: DataFrame, right: DataFrame, eps: float, block: int = 1024) -> DataFrame:
    """Links between left and right points of one cell that are within eps of each other, both sides cut into blocks of about ``block`` rows."""
    kind = dict(left.dtypes)["id"]

    def link(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []})
        x, y = np.stack(a["v"].to_numpy()).astype("float64"), np.stack(b["o_v"].to_numpy()).astype("float64")
        made = _linked(np.concatenate([a["id"].to_numpy(), b["o_id"].to_numpy()]), x, y, np.full(len(x), -1), np.full(len(y), -1), eps, len(x))
        return made[made["u"] != made["v"]]

    return block_pairs(left, right, "cell", ["id"], ["id"], link, f"u {kind}, v {kind}", block, block)


def _near_blocks(cells: DataFrame, units: list, centres: np.ndarray, eps: float, rows: int) -> DataFrame:
    """Links between points within eps of each other, block by block; pairs inside a core are left out.

    A pair of blocks returns one link per point it connects, not the pairs: the connections are the same and the output stays linear.
    """
    spark, kind = cells.sparkSession, dict(cells.dtypes)["id"]
    dealt, unit, own, pile = _blocks(units, centres, rows)
    at = centres[[units[i]["cell"] for i in unit]]
    radius = np.array([units[i]["radius"] for i in unit])
    near = []
    for b in range(int(own.max()) + 1):
        mine = np.flatnonzero(own == b)
        other = np.flatnonzero(own >= b)
        gap = np.sqrt(np.maximum((at[mine] ** 2).sum(1)[:, None] - 2 * at[mine] @ at[other].T + (at[other] ** 2).sum(1)[None, :], 0.0)) - radius[mine][:, None] - radius[other][None, :]
        meets = (gap <= eps + 1e-5) & ~(pile[mine][:, None] & (unit[mine][:, None] == unit[other][None, :]))
        near += [(b, int(o)) for o in np.unique(own[other[meets.any(axis=0)]])]
    if not near:
        return cells.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(group["v"].to_numpy()).astype("float64")
        return pd.DataFrame({"block": [group["block"].iloc[0]], "ids": [group["id"].to_numpy()], "x": [v.tobytes()], "pile": [np.where(group["core"], group["cell"], -1).astype("int32").tobytes()]})

    to = F.broadcast(spark.createDataFrame(dealt, "cell int, core boolean, first int, parts int"))
    placed = cells.join(to, ["cell", "core"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    packed = cut_lineage(placed.groupBy("block").applyInPandas(pack, f"block int, ids array<{kind}>, x binary, pile binary"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        ids = [np.asarray(i) for i in group["ids"]]
        x = [np.frombuffer(x).reshape(len(i), -1) for x, i in zip(group["x"], ids)]
        pile = [np.frombuffer(p, "int32") for p in group["pile"]]
        return _linked(np.concatenate(ids), x[0], x[-1], pile[0], pile[-1], eps, len(ids[0]) if len(ids) > 1 else 0)

    pairs = F.broadcast(spark.createDataFrame(near, "a int, b int"))
    sent = packed.join(pairs, F.col("block") == F.col("a")).unionByName(packed.join(pairs, (F.col("block") == F.col("b")) & (F.col("a") != F.col("b"))))
    return sent.groupBy("a", "b").applyInPandas(link, f"u {kind}, v {kind}")


def density_clusters(df: DataFrame, key: str, vec: str, eps: float, min_size: int = 2, pivots: int | None = None) -> DataFrame:
    """(key, cluster): chains of neighbours within ``eps``; groups below ``min_size`` are noise (-1, null for text keys).

    A cluster is named by its smallest key. Equal vectors are collapsed first and count as members.
    """
    rows = df.select(F.col(key), F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    noise = F.lit(None) if dict(df.dtypes)[key] == "string" else F.lit(-1)
    points = cut_lineage(rows.groupBy("v").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies")))
    roots = components(near_edges(points.select("id", "v"), eps, pivots))
    labelled = points.join(roots.withColumnRenamed("u", "id"), "id", "left").select(
        "v", "copies", F.coalesce("root", "id").alias("root"))
    sizes = labelled.groupBy("root").agg(F.sum("copies").alias("members"))
    named = labelled.join(sizes, "root").select("v", F.when(F.col("members") >= min_size, F.col("root")).otherwise(noise).alias("cluster"))
    return rows.join(named, "v").select(key, "cluster")


def _noise(label: str):
    return F.coalesce(F.col(label).cast("string"), F.lit("-1")) == "-1"


def cluster_members(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Clustered rows with the size of their cluster; noise is left out.

    One row per member: a very large cluster stays distributed instead of becoming one list.
    """
    kept = df.where(~_noise(label))
    return kept.join(kept.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)


def outliers(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.where(_noise(label))


def vocab_table(df: DataFrame, term: str, definition: str, use: str, types: Sequence[str]) -> DataFrame:
    """Terms with a definition, of the chosen use types."""
    return df.where(F.col(use).isin(list(types))).dropna(subset=[term, definition]).select(term, definition)
