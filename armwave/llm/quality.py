"""Quality rules as a ledger: every rule is evaluated once per text, its failure is one bit, its measurements
are columns; policies are masks over the bits, so that a new policy or an ablation needs no second pass over texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.llm.textbytes import RangeHash, per_text, text_slices, texts_of, word_runs, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals", "n_letters")

# Rules in bit order: name -> condition of failure over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "exclaims": "100 * n_exclaims > 20 * n_words",
    "capitals": "n_letters > 0 and 100 * n_capitals > 60 * n_letters",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
}

# Versioned policies: which rules reject a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "prose-1": ("few_words", "repeated_words", "symbols", "exclaims", "capitals"),
    "strict-1": tuple(RULES),
}


def mask_of(rules: tuple[str, ...] | list[str]) -> int:
    """The bit mask of rule names; an unknown name is an error."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _measured(batch: pa.RecordBatch, text: str, words_hash: RangeHash) -> list[np.ndarray]:
    t = texts_of(batch, text)
    w = words_of(t)
    sums = words_hash.sums(t.buf)
    inside = np.ones(len(t.buf), dtype=bool)
    inside[t.end] = False
    chars = np.concatenate(([0], np.cumsum((t.buf & 0xC0) != 0x80)))
    word_chars = np.bincount(w.text, weights=chars[w.end] - chars[w.start], minlength=t.n).astype(np.int64)
    symbol = np.isin(t.buf, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
    # Lines with a word; a line equals an earlier one when the same hash occurs before it in the text.
    ends = np.flatnonzero(t.buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    full = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(t.start, starts, side="right") - 1
    n_lines = np.bincount(of, minlength=t.n)
    hashes = words_hash.ranges(sums, starts, ends)
    order = np.lexsort((hashes, of))
    again = (np.diff(of[order], prepend=-1) == 0) & (np.diff(hashes[order], prepend=np.uint64(0)) == 0)
    dup = np.bincount(of[order][again], minlength=t.n)
    # Words of three-word windows that occur twice or more in their text.
    at, runs = word_runs(words_hash.ranges(sums, w.start, w.end), w, 3)
    order = np.lexsort((runs, w.text[at]))
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = (np.diff(w.text[at][order]) == 0) & (np.diff(runs[order]) == 0)
    hit = at[order][same[1:] | same[:-1]]
    covered = np.zeros(len(w.start), dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    repeat = np.bincount(w.text[covered], minlength=t.n)
    capital, small = (t.buf >= 65) & (t.buf <= 90), (t.buf >= 97) & (t.buf <= 122)
    count = lambda flags: per_text(np.flatnonzero(flags), t)
    return [w.count, word_chars, count(symbol), n_lines, dup, repeat, count(t.buf == 33), count(capital), count(capital | small)]


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, measurements, fail_bits) for every row: one pass over the texts, no shuffle.

    Null and empty texts have no words and fail ``few_words``. Repeated rows give repeated rows; a null key
    is kept. Only the two named columns are read, so other columns may have any name.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    # Line equality must see capitals, so the hash does not fold case.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = RangeHash(7)
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), *[pa.array(np.asarray(x, dtype=np.int64)) for x in _measured(part, "t", h)]], names=[key, *MEASURES])

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, schema)
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long")
    return rows.withColumn("fail_bits", bits)


def verdict(policy: str = "prose-1", bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str = "prose-1", bits: str = "fail_bits") -> DataFrame:
    """Per rule of a policy: texts that fail it, texts that only it rejects, and texts kept without it.

    The ledger is first counted per bit pattern (at most two to the number of rules rows).
    """
    names, mask = list(RULES), mask_of(POLICIES[policy])
    counts = ledger.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("m")) for r in POLICIES[policy]])
    one = F.col("b").bitwiseAND(F.col("r.m"))
    return (counts.select("b", "n", F.explode(rules).alias("r")).groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(one != 0, F.col("n")).otherwise(0)).alias("failed"),
                 F.sum(F.when(F.col("b") == F.col("r.m"), F.col("n")).otherwise(0)).alias("only_here"),
                 F.sum(F.when((F.col("b") == 0) | (F.col("b") == F.col("r.m")), F.col("n")).otherwise(0)).alias("kept_without")))


def keep_clean(docs: DataFrame, policy: str = "prose-1", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text passes the policy, with their columns as they were.

    The verdict is computed beside each row (no join, so equal or null keys do no harm).
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    needed = POLICIES[policy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = RangeHash(7)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pc.struct_field(batch.column("row"), text)], names=["t"])
            for first, part in text_slices(texts, "t"):
                measured = [pa.array(np.asarray(x, dtype=np.int64)) for x in _measured(part, "t", h)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, part.num_rows), *measured], names=["row", *MEASURES])

    rows = packed.mapInArrow(run, f"row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    for rule in needed:
        rows = rows.where(~F.expr(RULES[rule]))
    return rows.select("row.*")
