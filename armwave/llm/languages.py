"""Language of texts by interpolated Kneser-Ney character models, one per language value of the training rows.

Texts are lower-cased and cut to letters (with their marks); everything else is a single word border. A character is a
12-bit code, its code point or beyond U+0BFF a hash of it, so an n-gram of up to five characters is one whole number whose prefix and
suffix are shifts and masks. Tasks count n-grams of the highest order per language; lower orders hold
continuation counts, the number of distinct characters seen in front. With the discount D = n1 / (n1 + 2 n2) of each language and order,
P(w | h) = max(c(hw) - D, 0) / c(h) + gamma(h) P(w | h'), where gamma(h) is what the kept n-grams leave over,
down to the uniform distribution over codes.

The model is kept as sorted arrays per language and order: n-grams with their discounted share, histories with gamma.
Its size has a proven bound at every size of the corpus: an n-gram is kept if it makes up at least ``least`` times the number of languages
of its language's counts of that order, so at most 1 / ``least`` are kept per order. What is not kept goes into gamma, so
probabilities still add up to one.

A text gets the language with the lowest cross-entropy per character. One part of the training rows is not counted but
calibrates: the softness that turns differences of cross-entropy into probabilities, and per language the
cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armwave.llm.graph import stored
from armwave.llm.textbytes import text_slices

ORDER = 4
LEAST = 2e-6
BITS = 12
SLICE = 1 << 20
PENDING = 1 << 20        # n-grams that a task holds before it sums them up, and hands on when they are still as many
CACHE = 1 << 20          # scored n-grams that a task remembers
SOFTNESS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
SPREADS = 4.0
UNKNOWN = "und"
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Code of every code point (0: no letter), and whether it is a letter itself rather than a mark."""
    if not _TABLES:
        import unicodedata

        code, letter = np.zeros(0x110000, np.uint16), np.zeros(0x110000, bool)
        for c in range(0x32400):  # no letters are assigned beyond
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                code[c] = c if c < 0xC00 else 0xC00 + ((c * 2654435761) % (1 << 32) >> 22)
                letter[c] = kind == "L"
        _TABLES.extend([code, letter])
    return _TABLES[0], _TABLES[1]


@dataclass
class Coded:
    """n-grams of the texts of a slice: each scored character with its history, the first n-gram of every text, and letters per text."""

    grams: np.ndarray
    first: np.ndarray
    letters: np.ndarray


def coded(values: list[str], order: int = ORDER) -> Coded:
    """Scored are letters and the border after a word. A text begins after ``order - 1`` borders."""
    code, letter = tables()
    gap = "\0" * (order - 1)
    plain = [v.replace("\0", " ") if "\0" in v else v for v in values]
    points = np.frombuffer((gap + gap.join(plain) + "\0").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = code[points]
    start = np.zeros(len(points), bool)  # of the gap in front of each text
    edges = np.flatnonzero(points == 0)
    start[edges[:-1][:: max(1, order - 1)]] = True
    keep = (c != 0) | (points == 0)
    keep[1:] |= c[:-1] != 0
    alpha = np.concatenate([[0], np.cumsum(letter[points])])
    at = np.flatnonzero(start)
    letters = alpha[np.append(at[1:], len(points) - 1)] - alpha[at]
    c, start = c[keep].astype(np.int64), start[keep]
    grams = c.copy()
    for k in range(1, order):
        grams[k:] += c[:-k] << (BITS * k)
    scored = c != 0
    scored[1:] |= c[:-1] != 0
    before = np.concatenate([[0], np.cumsum(scored)])
    return Coded(grams[scored], before[np.flatnonzero(start) + 1], letters)  # the border at a gap's start ends the text before


def _texts(part: pa.RecordBatch) -> list[str]:
    return part.column("t").to_pylist()


def _counted(order: int):
    """Task: (lang, gram, n) of its texts, summed up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def summed() -> int:
            total = 0
            for lang, parts in waiting.items():
                keys, counts = (np.concatenate(x) for x in zip(*parts))
                u, place = np.unique(keys, return_inverse=True)
                waiting[lang] = [(u, np.bincount(place, weights=counts, minlength=len(u)).astype(np.int64))]
                total += len(u)
            return total

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in waiting.items():
                for keys, counts in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "g", "c"])

        for batch in batches:
            for _, part in text_slices(batch, "t", limit=SLICE):
                texts, langs = _texts(part), part.column("lang").to_pylist()
                for lang in dict.fromkeys(langs):
                    u, n = np.unique(coded([t for t, x in zip(texts, langs) if x == lang], order).grams, return_counts=True)
                    waiting.setdefault(lang, []).append((u, n.astype(np.int64)))
                    held += len(u)
                if held > PENDING:
                    held = summed()
                    if held > PENDING // 2:
                        yield from out()
                        waiting, held = {}, 0
        summed()
        yield from out()

    return run


@dataclass
class Models:
    """Per language and order sorted n-grams with shares and sorted histories with gammas."""

    langs: list[str]
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    histories: list[list[tuple[np.ndarray, np.ndarray]]]

    def log2(self, g: np.ndarray) -> np.ndarray:
        """Log probabilities (n-grams x languages); ``g`` in ascending order."""
        out = np.empty((len(g), len(self.langs)))
        for i in range(len(self.langs)):
            p = np.full(len(g), 1.0 / (1 << BITS))
            for k, (grams, histories) in enumerate(zip(self.grams[i], self.histories[i]), 1):
                own = g & ((1 << (BITS * k)) - 1)
                p = _found(*grams, own, 0.0) + _found(*histories, own >> BITS, 1.0) * p
            out[:, i] = np.log2(p)
        return out


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def fit(rows: DataFrame, order: int = ORDER, least: float = LEAST) -> Models:
    """Models of the rows (lang, t), neither null."""
    if not 2 <= order <= 5:
        raise ValueError("the order is 2 to 5")
    level = stored(rows.select("lang", "t").mapInArrow(_counted(order), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams")
    langs = sorted(r[0] for r in level.select("lang").distinct().collect())  # values of the language column in training
    share = least * max(1, len(langs))
    parts = []
    for k in range(order, 0, -1):
        if k < order:
            level = level.groupBy("lang", F.col("g").bitwiseAND((1 << (BITS * k)) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        n1, n2 = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        # Without counts of one or two the estimate is no number between 0 and 1; it is held to 0.1 to 0.9.
        discount = F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(F.lit(0.5))))
        stats = level.groupBy("lang").agg(discount.alias("d"), F.sum("c").alias("total"))
        history = Window.partitionBy("lang", "h")  # at most one row per code
        shares = level.join(F.broadcast(stats), "lang").withColumn("h", F.shiftright("g", BITS)).withColumn("value", F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.sum("c").over(history))
        parts.append(shares.where(F.col("c") >= F.lit(share) * F.col("total")).select(F.lit(k).alias("k"), "lang", "g", "h", "value"))
    kept = parts[0]
    for p in parts[1:]:
        kept = kept.unionByName(p)
    kept = stored(kept, "model")
    table = kept.select("k", "lang", "g", "value").toArrow()  # at most order / least rows
    ks, where, g, value = (table.column(c).to_numpy() for c in ("k", "lang", "g", "value"))
    grams, histories = [], []
    for lang in langs:
        own_grams, own_histories = [], []
        for k in range(1, order + 1):
            at = np.flatnonzero((ks == k) & (where == lang))
            at = at[np.argsort(g[at])]
            own_grams.append((g[at], value[at]))
            h, first = np.unique(g[at] >> BITS, return_index=True)
            own_histories.append((h, 1.0 - np.add.reduceat(value[at], first) if len(at) else np.zeros(0)))
        grams.append(own_grams)
        histories.append(own_histories)
    return Models(langs, grams, histories)


class Scorer:
    """Scores n-grams of slice after slice; remembers the scores of a bounded number of them."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.keys, self.values = np.zeros(0, np.int64), np.zeros((0, len(models.langs)))

    def log2(self, u: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == u[inside]
        out = np.empty((len(u), len(self.models.langs)))
        out[known] = self.values[at[known]]
        new = u[~known]
        if len(new):
            out[~known] = fresh = self.models.log2(new)
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.values = new[: CACHE], fresh[: CACHE]
            elif len(new) > 0.01 * len(u):
                places = np.searchsorted(self.keys, new)
                self.keys, self.values = np.insert(self.keys, places, new), np.insert(self.values, places, fresh, axis=0)
        return out

    def entropies(self, values: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scored characters, bits per character (texts x languages; 0 without characters), and letters, per text."""
        c = coded(values, order)
        u, place = np.unique(c.grams, return_inverse=True)
        scores = self.log2(u)
        n = np.diff(np.append(c.first, len(c.grams)))
        some = np.flatnonzero(n > 0)
        bits = np.zeros((len(n), len(self.models.langs)))
        for i in range(len(self.models.langs) if len(some) else 0):
            bits[some, i] = -np.add.reduceat(scores[place, i], c.first[some]) / n[some]
        return n, bits, c.letters


def part_of(key: Column, parts: int = 4) -> Column:
    """crc32 of the key as text modulo the number of parts (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def _softness(known: DataFrame, langs: list[str]) -> float:
    """Softness with the least mean negative log probability of the true language; the largest if nothing calibrates."""
    true = F.element_at("bits", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int"))
    low = F.array_min("bits")
    losses = [F.avg(b * (true - low) + F.log(F.aggregate("bits", F.lit(0.0), lambda s, x: s + F.exp(-b * (x - low))))) for b in SOFTNESS]
    row = known.agg(*[F.round(x, 6) for x in losses]).first()
    return SOFTNESS[-1] if row[0] is None else min(zip(row, SOFTNESS))[1]


def identify(docs: DataFrame, trains: Column, calibrates: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = ORDER, least: float = LEAST,
             sure: float = 0.5) -> DataFrame:
    """(key, lang_pred, score, bits_per_char, accepted) for every row.

    Learns text and language of rows where ``trains`` is true and neither is null; rows where ``calibrates`` is true set the softness and the limits.
    ``lang_pred`` is the learned language with the fewest bits per character (the first in code-point order on ties), ``und`` with score 0 if
    the text is null or has no letter, or nothing was learned. ``score`` is its calibrated probability. ``accepted`` says that the
    score is at least ``sure`` and the bits are within the language's limit, mean plus four standard deviations of
    the calibrating rows that are predicted right (no limit where there are none). Rows that repeat a key are rows. Only the named columns are read.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.col(f"`{text}`").isNotNull().alias("has"),
                       F.col(f"`{lang}`").cast("string").alias("lang"), flag(trains).alias("trains"), flag(calibrates).alias("calibrates"))
    models = fit(rows.where(F.col("trains") & F.col("has") & F.col("lang").isNotNull()), order, least)
    names = models.langs
    if not names:
        return rows.select(F.col("id").alias(key), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_char"), F.lit(False).alias("accepted"))
    shared = spark.sparkContext.broadcast(models)  # at most 2 * order / least pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            for _, part in text_slices(batch, "t", limit=SLICE):
                n, bits, letters = scorer.entropies(_texts(part), order)
                sizes = np.where(letters > 0, len(names), 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.round(bits[letters > 0], 6).ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "lang", "calibrates")], pa.array(n.astype(np.int64)), lists], names=["id", "lang", "calibrates", "n", "bits"])

    scored = stored(rows.select("id", "t", "lang", "calibrates").mapInArrow(run, f"id {kind}, lang string, calibrates boolean, n long, bits array<double>"), "entropies")
    low = F.array_min("bits")
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("bits", low).cast("int"))
    scored = scored.withColumn("best", F.when(F.size("bits") > 0, best)).withColumn("low", F.when(F.size("bits") > 0, low))
    known = scored.where(F.col("calibrates") & F.col("best").isNotNull() & F.col("lang").isin(names))
    soft = _softness(known, names)
    limits = {r.best: r.limit for r in known.where("best = lang").groupBy("best").agg(F.round(F.avg("low") + SPREADS * F.stddev_pop("low"), 4).alias("limit")).collect()}  # one row a language
    limit = F.element_at(F.array(*[F.lit(limits.get(x)).cast("double") for x in names]), F.array_position(F.array(*map(F.lit, names)), F.col("best")).cast("int"))
    chance = F.round(1.0 / F.aggregate("bits", F.lit(0.0), lambda s, x: s + F.exp(-soft * (x - F.col("low")))), 6)
    score = F.when(F.col("best").isNotNull(), chance).otherwise(F.lit(0.0))
    return scored.select(F.col("id").alias(key), F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), F.col("low").alias("bits_per_char"),
                         (F.col("best").isNotNull() & (score >= sure) & F.coalesce(F.col("low") <= limit, F.lit(True))).alias("accepted"))
