"""Exact n-gram Jaccard join as a blocked sparse matrix product.

The product of the document by n-gram incidence matrix with its transpose is summed column block by column block
(hash ranges of n-grams). A pair can only reach the threshold if it shares one of the first
``n - ceil(t n) + 1`` n-grams of either text under any fixed order of n-grams, so the product is first taken
over these columns; pairs whose count and remaining n-grams stay below the overlap that both sizes imply are discarded, and only
the pairs left get their full count from the whole texts. The order puts n-grams seen often last, which
keeps columns short; it affects the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.llm.graph import components, dropped, stored
from armwave.llm.textbytes import RangeHash, Texts, mix, text_slices, texts_of, word_runs, words_of

OFTEN = 500_000       # n-grams put last in the order (8 MB broadcast)
SEEN_IN_A_BLOCK = 3   # ... among those that this many texts of one block of about six million n-grams hold
BLOCK_GRAMS = 6_000_000
SKETCHES = 4          # minimum hashes for the first, cheap linking round


def shingles(t: Texts, words_hash: RangeHash, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted; a text of fewer words is one shingle."""
    w = words_of(t)
    h = words_hash.ranges(words_hash.sums(t.buf), w.start, w.end)
    at, runs = word_runs(h, w, width)
    texts, hashes = [w.text[at]], [runs]
    for k in range(1, width):
        at, runs = word_runs(h, w, k)
        short = w.count[w.text[at]] == k
        texts.append(w.text[at][short])
        hashes.append(runs[short])
    text, value = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _often(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams to put last, and their counts. Every text is counted; what is kept has a fixed size."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        keep = count >= SEEN_IN_A_BLOCK
        return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], names=["g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, parts, n = RangeHash(5, lower=True), [], 0
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                parts.append(shingles(texts_of(part, "t"), h, width)[1])
                n += len(parts[-1])
                if n >= BLOCK_GRAMS:
                    yield counted(parts)
                    parts, n = [], 0
        if parts:
            yield counted(parts)

    # Few large tasks: a block must be large to tell what is frequent.
    tasks = rows.select("t").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    counts = tasks.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "g").limit(OFTEN).toArrow()
    grams = top.column("g").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top.column("c").to_numpy().astype(np.int64)[order]


def _need(n, percent: int):
    """Smallest overlap a text of n shingles needs with any partner."""
    return -(-percent * n // 100)


def _profiles(rows: DataFrame, often: tuple[np.ndarray, np.ndarray], width: int, percent: int, kind: str) -> DataFrame:
    """Per row: n, a 128-bit fingerprint of the set, minimum hashes, and the first n-grams in the order."""

    grams, counts = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = RangeHash(5, lower=True)
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                t = texts_of(part, "t")
                text, value = shingles(t, h, width)
                n = np.bincount(text, minlength=t.n).astype(np.int64)
                first = np.cumsum(n) - n
                full = n > 0
                prints = []
                for salt in (11, 12):
                    out = np.zeros(t.n, dtype=np.uint64)
                    if len(value):
                        out[full] = np.add.reduceat(mix(value, salt), first[full])
                    prints.append(out)
                sketch = np.zeros((t.n, SKETCHES), dtype=np.uint64)
                for k in range(SKETCHES):
                    if len(value):
                        sketch[full, k] = np.minimum.reduceat(mix(value, 20 + k), first[full])
                late = np.zeros(len(value), dtype=np.int64)
                if len(grams):
                    place = np.minimum(np.searchsorted(grams, value), len(grams) - 1)
                    late = np.where(grams[place] == value, counts[place], 0)
                order = np.lexsort((value, late, text))
                length = np.where(full, n - _need(n, percent) + 1, 0)
                keep = np.arange(len(value)) - first[text] < length[text]
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(n), *[pa.array(p.view(np.int64)) for p in prints],
                    pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * SKETCHES), pa.array(sketch.reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order][keep].view(np.int64)))],
                    names=["id", "n", "p1", "p2", "sketch", "front"])

    return rows.mapInArrow(run, f"id {kind}, n long, p1 long, p2 long, sketch array<long>, front array<long>")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings (g, id, n) whose n-gram another posting has: sorted ranges, compared with their neighbours.

    A posting at the edge of a range is kept without a neighbour's word; a lone one pairs with nothing later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            same = g[1:] == g[:-1]
            keep = np.zeros(len(g), dtype=bool)
            keep[1:] = same
            keep[:-1] |= same
            keep[[0, -1]] = True  # edges of a batch: the neighbour is in another one
            held = batch.filter(pa.array(keep))
            yield held

    return postings.repartitionByRange("g", "id").sortWithinPartitions("g", "id").mapInArrow(run, postings.schema)


def _linked(pairs: DataFrame, rows: DataFrame, width: int, percent: int, made: list[DataFrame] | None = None) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold, stored. Only texts of ids in a pair are kept; equal rows (id, t) are one.

    Rows are dealt out by id once, which serves both the choice and the removal of equal rows. The hint keeps that plan at any size:
    the ids grow with the input, so they are not to be broadcast.
    """
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stored(rows.join(ids.hint("merge"), "id", "left_semi").distinct(), "texts", "zstd")
    links = stored(_verified(pairs, texts, width, percent), "verified", made=made)
    dropped(pairs)
    dropped(texts)
    return links


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    one = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    rows = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = RangeHash(5, lower=True)
        for batch in batches:
            for _, part in text_slices(batch, "ta", "tb"):
                ra, va = shingles(texts_of(part, "ta"), h, width)
                rb, vb = shingles(texts_of(part, "tb"), h, width)
                na, nb = np.bincount(ra, minlength=part.num_rows), np.bincount(rb, minlength=part.num_rows)
                row, value = np.concatenate((ra, rb)), np.concatenate((va, vb))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=part.num_rows)
                yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * (na + nb - both)) & (both > 0)))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, made: list[DataFrame] | None = None) -> DataFrame:
    """(key, n_shingles, component_id) per row: components of all links with Jaccard similarity >= percent / 100.

    Null or empty texts and texts without words have 0 shingles and are their own component. Rows with a null
    key link with nothing and have a null component. Equal texts are one vertex, so copies are not paired.
    Rows that repeat a key with other texts pool their links. Other columns are not read. An empty table
    gives an empty result.

    Shingles are 64-bit hashes, sets are compared by 128-bit fingerprints.

    Links inside large groups of near copies: a first round links texts to the smallest id that shares one of a few
    minimum hashes (a star, verified). The product then only meets pairs of different components: in each
    column the members of its largest component are met by the others, not by each other.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    profile = stored(_profiles(rows, _often(rows, width), width, percent, kind), "profiles", made=made)
    known = profile.where("n > 0 and id is not null")
    same = known.groupBy("p1", "p2", "n").agg(F.min("id").alias("rep"))
    postings = _shared(known.select(F.posexplode("front").alias("pos", "g"), "id", "n").select("g", "id", "n", "pos"))
    reps = same.select(F.col("rep").alias("id"), "n").distinct()
    postings = stored(postings.join(reps, ["id", "n"], "left_semi"), "postings")
    present = postings.select("id").distinct()

    stars = (known.join(present, "id", "left_semi").select("id", "n", F.posexplode("sketch").alias("k", "h")))
    hubs = stars.groupBy("k", "h").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = (stars.join(hubs, ["k", "h"]).where((F.col("id") != F.col("hub.id")) & _sizes_fit(F.col("n"), F.col("hub.n"), percent))
             .select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct())
    star_links = _linked(first, rows, width, percent, made)
    label = components(star_links)
    at = stored(postings.join(label, "id", "left").select("g", "id", "n", "pos", F.coalesce("root", "id").alias("label")), "labelled", made=made)
    dropped(postings)
    by_label = at.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_label.groupBy("g").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    cells = at.join(mixed.select("g", F.col("top.label").alias("top")), "g")
    x = cells.where("label != top").select("g", *[F.col(c).alias("x" + c) for c in ("id", "n", "pos", "label")])
    y = cells.select("g", *[F.col(c).alias("y" + c) for c in ("id", "n", "pos", "label")], (F.col("label") == F.col("top")).alias("main"))
    overlap = F.ceil((F.col("xn") + F.col("yn")) * percent / (100 + percent) - F.lit(1e-9))
    # Texts that share so many n-grams share one of the first n - overlap + 1 of either.
    front = (F.col("xpos") <= F.col("xn") - overlap) & (F.col("ypos") <= F.col("yn") - overlap)
    met = x.join(y, "g").where((F.col("xlabel") != F.col("ylabel")) & front & (F.col("main") | (F.col("xid") < F.col("yid"))))
    low = F.col("xid") < F.col("yid")
    pick = lambda a, b: F.struct(*[F.when(low, F.col(a + c)).otherwise(F.col(b + c)).alias(c) for c in ("id", "n")])
    left = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos")) - 1
    counted = (met.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), left.alias("left"), overlap.alias("overlap"))
               .groupBy("a", "b", "overlap").agg(F.count(F.lit(1)).alias("c"), F.min("left").alias("left")))
    # All n-grams in common up to the last one seen are counted; no more can follow than either text has left.
    pairs = counted.where("c + left >= overlap").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    links = star_links.unionByName(_linked(pairs, rows, width, percent, made))
    root = components(links)

    named = same.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("p1", "p2", "n", F.coalesce("root", "rep").alias("component_id"))
    out = profile.select("id", "n", "p1", "p2").join(named, ["p1", "p2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), component).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each class (its smallest key); rows equal in key and text once.

    Rows with a null key stay.
    """
    made: list[DataFrame] = []
    found = classes(docs, text, key, width, percent, made)
    chosen = stored(found.where(F.col(f"`{key}`") == F.col("component_id")).select(key).distinct(), "chosen")
    for table in made:  # only the chosen keys are needed from here on
        dropped(table)
    held = docs.join(chosen, key, "left_semi").select(docs.columns).dropDuplicates([key, text])
    return held.unionByName(docs.where(F.col(f"`{key}`").isNull()))
