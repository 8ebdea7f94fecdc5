"""Exact removal of byte strings of a given length that start more than once in a corpus.

A suffix array over every byte is not built: suffixes are taken at anchors. Every string of ``length`` bytes
has one anchor, the smallest of its ``window`` hashed leading grams (the leftmost on ties), so equal strings
have equal anchors. Strings next to each other that share an anchor form a run. Sampled splitters range-partition
the runs by the gram at their anchor, then by a hash of all bytes of the run; ranges are sorted and each run is
compared with its neighbours, across range boundaries too:

* equal run bytes: every string of the run is repeated;
* equal grams but other bytes: only some strings may be; those runs are read again string by string, and their
  strings are sorted and compared in the same way.

The units of a string are bytes or words ``[^\\x20\\x09-\\x0D]+``; white space between words then does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.llm.graph import dropped, stored
from armwave.llm.textbytes import RangeHash, Texts, mix, text_slices, texts_of, words_of

SAME, NEAR, FIRST, LAST = 0, 1, 2, 3


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def _units(t: Texts, h: RangeHash, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums over the units of all texts, and each text's range of units."""
    sums = h.sums(t.buf)
    if unit == "byte":
        return sums, t.start, t.end
    w = words_of(t)
    return h.sums_of(h.ranges(sums, w.start, w.end)), w.first, w.first + w.count


def _runs(t: Texts, h: RangeHash, length: int, window: int, unit: str) -> tuple[np.ndarray, ...]:
    """(text, first string, strings, gram hash, run hash) of all runs; starts are relative to the text."""
    empty = np.zeros(0, np.int64)
    sums, begin, end = _units(t, h, unit)
    if len(sums) <= length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = h.grams(sums, length - window + 1)
    place = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_minima(place, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(end - begin - length + 1, 0)
    text = np.repeat(np.arange(t.n), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[text]
    if not len(at):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    a = anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    whole = h.ranges(sums, start, start + count - 1 + length) ^ mix((a[first] - start).astype(np.uint64), 3)
    return text[first], start - begin[text[first]], count, grams[a[first]], whole


def _neighbours(rows: DataFrame, made: list[DataFrame] | None) -> DataFrame:
    """Rows (g, c, id, th, p, k) compared with their neighbours in the order of (g, c): mark SAME where g and c
    equal a neighbour's, NEAR where only g does. Other rows go.

    Each range also gives its first and last row; these few (two a range) are compared on the driver.
    """
    kinds = rows.schema
    out_schema = "part int, mark int, g long, c long, id {}, th int, p int, k int".format(kinds["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def marked(b: pa.RecordBatch, mark: int) -> pa.RecordBatch:
            n = b.num_rows
            head = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, mark, np.int32))]
            return pa.RecordBatch.from_arrays([*head, *b.columns], names=["part", "mark", *b.schema.names])

        last, flags = None, None  # the last row of the batch before, and what is known of it
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield marked(batch.slice(0, 1), FIRST)
            else:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            g, c = batch.column("g").to_numpy(), batch.column("c").to_numpy()
            near = g[1:] == g[:-1]
            same = near & (c[1:] == c[:-1])
            near &= ~same
            is_same, is_near = np.zeros(len(g), bool), np.zeros(len(g), bool)
            if flags is not None:
                is_same[0], is_near[0] = flags
            is_same[1:] |= same
            is_same[:-1] |= same
            is_near[1:] |= near
            is_near[:-1] |= near
            flags = (is_same[-1], is_near[-1])
            last = batch.slice(batch.num_rows - 1, 1)
            for mark, flag in ((SAME, is_same), (NEAR, is_near)):
                flag[-1] = False  # told with the next batch, or at the end
                if flag.any():
                    yield marked(batch.filter(pa.array(flag)), mark)
        if last is not None:
            for mark, flag in ((SAME, flags[0]), (NEAR, flags[1]), (LAST, True)):
                if flag:
                    yield marked(last, mark)

    found = stored(rows.repartitionByRange("g", "c", "id", "th", "p").sortWithinPartitions("g", "c").mapInArrow(run, out_schema), "neighbours", made=made)
    edges = found.where(F.col("mark") >= FIRST).orderBy("part", "mark").collect()
    across = []
    for x, y in zip(edges, edges[1:]):
        if x.part != y.part and x.g == y.g:
            across += [(r.part, SAME if x.c == y.c else NEAR, *r[2:]) for r in (x, y)]
    inner = found.where(F.col("mark") < FIRST)
    return inner.unionByName(found.sparkSession.createDataFrame(across, found.schema)) if across else inner


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("id"), F.hash(t).alias("th"), t.alias("t"))


def _by_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    r = right.withColumnRenamed("id", "id_").withColumnRenamed("th", "th_")
    return left.join(r, left["id"].eqNullSafe(r["id_"]) & (left["th"] == r["th_"]), how).drop("id_", "th_")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, window: int = 192, made: list[DataFrame] | None = None, unit: str = "byte") -> DataFrame:
    """(id, th, starts, ends) with the maximal ranges [start, end) of units covered by strings of ``length`` units that also
    start elsewhere (another text or another place of the same one); texts without any have no row.

    ``th`` is a 32-bit hash of the text, so that rows with one key and other texts are told apart; equal rows
    repeat each other. Null texts count as empty, texts shorter than ``length`` have no strings. A null key is
    a value like any other. Runs are compared by 128 bits, single strings by 64.
    """
    rows = _rows(docs, text, key)
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"g long, c long, id {kind}, th int, p int, k int"

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = RangeHash(21)
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                of, p, k, g, c = _runs(texts_of(part, "t"), h, length, window, unit)
                own = part.select(["id", "th"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), own.column("id"), own.column("th"),
                     pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32))], names=["g", "c", "id", "th", "p", "k"])

    runs = _neighbours(stored(rows.mapInArrow(all_runs, shape), "runs", made=made), made)
    asked = runs.where(F.col("mark") == NEAR).groupBy("id", "th").agg(F.collect_set(F.struct("p", "k")).alias("asked"))

    def all_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = RangeHash(22)
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                t = texts_of(part, "t")
                sums, begin, _ = _units(t, h, unit)
                grams = h.grams(sums, length)
                lists = part.column("asked")
                of = np.repeat(np.arange(t.n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                items = lists.flatten()
                p, k = items.field("p").to_numpy().astype(np.int64), items.field("k").to_numpy().astype(np.int64)
                each = np.repeat(np.arange(len(p)), k)
                at = p[each] + np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
                own = part.select(["id", "th"]).take(pa.array(of[each]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[begin[of[each]] + at].view(np.int64)), pa.array(np.zeros(len(at), np.int64)), own.column("id"),
                     own.column("th"), pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int32))],
                    names=["g", "c", "id", "th", "p", "k"])

    again = _by_row(rows, asked, "inner")
    strings = _neighbours(again.mapInArrow(all_strings, shape), made)
    hits = runs.unionByName(strings).where(F.col("mark") == SAME).select("id", "th", "p", (F.col("p") + F.col("k") - 1 + length).alias("e"))
    lists = hits.groupBy("id", "th").agg(F.collect_set(F.struct("p", "e")).alias("hits"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, sizes = [], [], []
            for row in range(batch.num_rows):
                items = batch.column("hits").slice(row, 1).flatten()
                p, e = items.field("p").to_numpy(), items.field("e").to_numpy()
                order = np.argsort(p, kind="stable")
                p, e = p[order], np.maximum.accumulate(e[order])
                cut = np.flatnonzero(p[1:] > e[:-1])
                starts.append(p[np.append(0, cut + 1)])
                ends.append(e[np.append(cut, len(e) - 1)])
                sizes.append(len(cut) + 1)
            offsets = np.cumsum([0, *sizes]).astype(np.int32)
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32())
            make = lambda x: pa.ListArray.from_arrays(pa.array(offsets), flat(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), make(starts), make(ends)], names=["id", "th", "starts", "ends"])

    return lists.mapInArrow(merged, f"id {kind}, th int, starts array<int>, ends array<int>")


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray, whole_chars: bool) -> bytes:
    pieces, done = [], 0
    for s, e in zip(starts, ends):
        if whole_chars:  # the cut shrinks to whole code points
            while s < e and text[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
        pieces.append(text[done:s])
        done = e
    return b"".join([*pieces, text[done:]])


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, window: int = 192, unit: str = "byte") -> DataFrame:
    """(row, kept, whole, n_bytes, n_removed, n_spans) for every row: its columns as a struct, and the bytes left.

    For ``whole`` cuts shrink to whole code points, so that what is left is UTF-8 again. With words as units a cut goes from
    the first byte of its first word to the last one of its last word.
    """
    made: list[DataFrame] = []
    spans = stored(repeated_spans(docs, text, key, length, window, made, unit), "spans")
    for table in made:  # only the spans are needed from here on
        dropped(table)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    packed = docs.select(F.col(f"`{key}`").alias("id"), F.hash(t).alias("th"), t.alias("t"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    joined = _by_row(packed, spans, "left").select("row", "t", "starts", "ends")
    shape = f"row {packed.schema['row'].dataType.simpleString()}, kept binary, whole binary, n_bytes long, n_removed long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                left, whole, sizes, gone, count = [], [], [], [], []
                if unit == "word":
                    t = texts_of(part, "t")
                    w = words_of(t)
                for row, (value, s, e) in enumerate(zip(part.column("t").cast(pa.large_binary()), part.column("starts"), part.column("ends"))):
                    value = value.as_py()
                    s, e = (s.values.to_numpy(), e.values.to_numpy()) if s.is_valid else ((), ())
                    if unit == "word" and len(s):
                        s, e = w.start[w.first[row] + s] - t.start[row], w.end[w.first[row] + e - 1] - t.start[row]
                    left.append(_kept(value, s, e, False) if len(s) else value)
                    whole.append(_kept(value, s, e, True) if len(s) else value)
                    sizes.append(len(value))
                    gone.append(int(sum(e) - sum(s)))
                    count.append(len(s))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(left, pa.binary()), pa.array(whole, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, gone, count)]],
                                                 names=["row", "kept", "whole", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, shape)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, chars: str | None = "n_chars", window: int = 192, unit: str = "byte") -> DataFrame:
    """``docs`` with repeated strings cut out of the texts (and the count of characters renewed). Null texts stay null."""
    out = cut(docs.withColumn("_no_text", F.col(f"`{text}`").isNull()), text, key, length, window, unit)
    new: Column = F.when(~F.col("row._no_text"), F.decode("whole", "UTF-8"))
    fields = []
    for c in docs.columns:
        if c == text:
            fields.append(new.alias(c))
        elif c == chars:
            kind = docs.schema[c].dataType
            fields.append(F.when(F.col("n_removed") > 0, F.length(new).cast(kind)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            fields.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*fields)
