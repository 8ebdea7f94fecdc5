"""Smoothed n-gram scores by a weighted backoff automaton.

With counts c and a prior of ``mu`` occurrences spread like the lower order, p(w | h) = (c(h, w) + mu p(w | h')) / (c(h) + mu). States are the
histories that occur in training. A state has an arc for every word that followed it, of weight log10 p(w | h), to the longest history that
ends in the word, and a failure arc to the history without its first word, of weight log10(mu / (c(h) + mu)): what the formula
leaves of the lower order where c(h, w) = 0. The empty history has an arc for every word. A text starts in the state of its start
signs, is read once from left to right, and its log probability is the sum of the weights of the arcs taken. Each
block of texts gets the part of the automaton that its n-grams can reach; its texts are read side by side.

Texts are packed into blocks of bounded size. A block asks for the counts of its distinct n-grams: sorted
hashes, cut into ranges, go to the task of their range, which sums the counts of all blocks and sends back
numbers in the order asked. What travels is in proportion to the corpus; a task holds one block or one range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwave.llm.graph import stored
from armwave.llm.textbytes import RangeHash, mix, text_slices, texts_of, words_of
from armwave.llm.warc import open_store
from armwave.session import scratch_path

BLOCK_BYTES = 12 << 20
PRIORS = (None, 4000.0, 2.0)  # mu of one-word and two-word histories; also sets the order of the model
END, START = np.uint64(0x9D5C0FB7A31E64D3), np.uint64(0x2B7E151628AED2A6)
LANE = 512  # tokens of a text that are read in one go
BITS = (64, 56)  # of the hashes of words, and of longer n-grams, of which there are most
_U = np.uint64


def _pack(docs: DataFrame, path: str) -> DataFrame:
    """Texts in blocks in files of the shared folder; (file, offset, length) per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrows"
        parts: list[pa.RecordBatch] = []
        rows: list[tuple[int, int]] = []
        with store.open_output_stream(f"{folder}/{name}", compression=None) as f:

            def flush() -> None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    for p in parts:
                        w.write_batch(p)
                data = sink.getvalue()
                rows.append((rows[-1][0] + rows[-1][1] if rows else 0, data.size))
                f.write(data)
                parts.clear()

            size = 0
            for batch in batches:
                for _, part in text_slices(batch, "t"):
                    parts.append(part)
                    size += part.column("t").nbytes
                    if size >= BLOCK_BYTES:
                        flush()
                        size = 0
            if parts:
                flush()
        out = [pa.array([f"{path}/{name}"] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays(out, names=["file", "offset", "length"])

    return stored(docs.mapInArrow(run, "file string, offset long, length long"), "blocks")


def _unpack(file: str, offset: int, length: int) -> list[pa.RecordBatch]:
    store, name = open_store(file)
    with store.open_input_file(name) as f:
        return list(pa.ipc.open_stream(f.read_at(length, offset)))


@dataclass
class Block:
    """Tokens of a block: hash, text and whether its text trains; first token of every text; n-gram hashes by order."""

    ids: pa.Array
    held: np.ndarray
    text: np.ndarray
    first: np.ndarray
    grams: list[np.ndarray]


def _tokens(batches: list[pa.RecordBatch], order: int) -> Block:
    h = RangeHash(41, lower=True)
    hashes, counts = [], []
    for part in batches:
        for _, piece in text_slices(part, "t"):
            t = texts_of(piece, "t")
            w = words_of(t)
            value = h.ranges(h.sums(t.buf), w.start, w.end)
            out = np.full(len(value) + t.n, END)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(w.count + 1) - 1] = False
            out[keep] = value
            hashes.append(out)
            counts.append(w.count + 1)
    token, count = np.concatenate(hashes), np.concatenate(counts)
    text, first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    ids = pa.concat_arrays([b.column("id") for b in batches])
    held = np.concatenate([b.column("held").to_numpy(zero_copy_only=False) for b in batches]).astype(bool)
    grams, history = [mix(token, 1)], token
    opening = np.arange(len(token)) == first[text]
    for k in range(1, order):  # the token k places before, start signs before a text's first token
        history = np.where(opening, START, np.roll(history, 1))
        grams.append(mix(grams[-1] * _U(0xD1342543DE82EF95) + history * _U(0x8CB92BA72F3D8DD7), k + 1) >> _U(64 - BITS[1]))
    return Block(ids, held, text, first, grams)


def _ask(b: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of one order, their counts in training texts, and the place of each token's n-gram."""
    keys, place = np.unique(b.grams[k], return_inverse=True)
    counts = np.bincount(place[~b.held[b.text]], minlength=len(keys))
    return keys, counts, place


def _squeeze(sorted_keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, in five or six bytes each where they fit."""
    step = np.diff(sorted_keys, prepend=_U(0))
    most = int(step[1:].max(initial=_U(0)))
    width = 5 if most < 1 << 40 else 6 if most < 1 << 48 else 8
    head = sorted_keys[:1].tobytes()
    return bytes([width]) + head + np.ascontiguousarray(step[1:].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, count=8, offset=1)
    out[1:, :width] = body
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def _numbers(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + pa.compress(x.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _read_numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64)


@dataclass
class Automaton:
    """Arcs sorted by state and word, weights and targets; failure arcs by state; arcs of the empty history (state 0) by word."""

    words: int
    arcs: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    root_weight: np.ndarray
    root_target: np.ndarray

    @staticmethod
    def of(b: Block, place: list[np.ndarray], counts: list[np.ndarray], lowest: np.ndarray, priors: tuple, texts: float) -> Automaton:
        """From the training counts of a block's distinct n-grams; ``place`` is the n-gram of each token by order, ``texts`` the number of training texts.

        State k below the order is the history of k start signs, then come the n-grams of one word, of two, and so on.
        """
        order, words, at = len(priors), len(counts[0]), np.arange(len(b.text)) - b.first[b.text]
        base = np.cumsum([order, *map(len, counts[:-1])])
        p, arcs, weight, target = lowest, [], [], []
        fail, fail_weight = [np.zeros(1, np.int64), np.arange(order - 1)], [np.zeros(1), np.log10([priors[k] / (texts + priors[k]) for k in range(1, order)])]
        for k in range(1, order):
            end = np.zeros(len(counts[k]), np.int64)
            end[place[k]] = np.arange(len(b.text))  # a token that ends the n-gram
            opening, known = at[end] == 0, np.flatnonzero(counts[k] > 0)
            shorter, history = place[k - 1][end], place[k - 1][end - 1]
            p = (counts[k] + priors[k] * p[shorter]) / (np.where(opening, texts, counts[k - 1][history]) + priors[k])
            source = np.where(opening, k, base[k - 1] + history)
            to = base[k] + np.arange(len(end)) if k + 1 < order else base[k - 1] + shorter
            arcs.append((source * words + place[0][end])[known])
            weight.append(np.log10(p[known]))
            target.append(to[known])
            last = np.zeros(len(counts[k - 1]), np.int64)
            last[place[k - 1]] = np.arange(len(b.text))
            fail.append(np.zeros(len(last), np.int64) if k == 1 else base[k - 2] + place[k - 2][last])
            fail_weight.append(np.log10(priors[k] / (counts[k - 1] + priors[k])))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        key, arcs = join(arcs, np.int64), None
        sort = np.argsort(key)
        root = np.where((counts[0] > 0) & (order > 1), base[0] + np.arange(words), 0)
        return Automaton(words, key[sort], join(weight, float)[sort], join(target, np.int64)[sort], np.concatenate(fail), np.concatenate(fail_weight), np.log10(lowest), root)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of reading one word in each state."""
        out, weight = self.root_target[word], np.zeros(len(word))
        left = np.arange(len(word))
        while len(left):
            inner = state > 0
            weight[left[~inner]] += self.root_weight[word[left[~inner]]]
            left, state = left[inner], state[inner]
            key = state * self.words + word[left]
            i = np.searchsorted(self.arcs, key)
            hit = i < len(self.arcs)
            hit[hit] = self.arcs[i[hit]] == key[hit]
            out[left[hit]] = self.target[i[hit]]
            weight[left[hit]] += self.weight[i[hit]]
            left, state = left[~hit], state[~hit]
            weight[left] += self.fail_weight[state]
            state = self.fail[state]
        return out, weight

    def read(self, word: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
        """Log probability of every text. Long texts are read in lanes; a later lane finds its state from the words just before it, which is all a state can hold."""
        size = np.diff(np.append(first, len(word)))
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(first)), lanes)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = first[text] + turn * LANE
        length = np.minimum(LANE, size[text] - turn * LANE)
        sort = np.argsort(-length, kind="stable")
        text, turn, begin, length = text[sort], turn[sort], begin[sort], length[sort]
        state = np.where(turn == 0, order - 1, 0)
        later = np.flatnonzero(turn)
        for back in range(order - 1, 0, -1):
            state[later] = self.step(state[later], word[begin[later] - back])[0]
        total = np.zeros(len(text))
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # lanes longer than each step
        for j, n in enumerate(live.tolist()):
            state, weight = self.step(state[:n], word[begin[:n] + j])
            total[:n] += weight
        return np.bincount(text, weights=total, minlength=len(first))


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 2 when divided by 7 (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", priors: tuple = PRIORS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from rows not ``held``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end per text; null and empty texts are one
    end. ``base_score`` is the add-one unigram score, the lowest order of the model. Without training tokens all words are
    unknown. A null ``held`` counts as false. Words are 64-bit hashes, longer n-grams 56-bit ones. Other columns are not read.
    """
    spark, order = docs.sparkSession, len(priors)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    blocks = _pack(rows, scratch_path(spark, "packs"))
    ranges = max(1, blocks.count())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [np.array([(i << bits) // ranges for i in range(1, ranges)], dtype=np.uint64) for bits in BITS]
        for batch in batches:
            for row in batch.to_pylist():
                b = _tokens(_unpack(row["file"], row["offset"], row["length"]), order)
                for k in range(order):
                    keys, counts, _ = _ask(b, k)
                    cut = [0, *np.searchsorted(keys, edges[min(k, 1)]).tolist(), len(keys)]
                    full = [(i, x, y) for i, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["file"]] * len(full), pa.string()), pa.array([row["offset"]] * len(full), pa.int64()), pa.array([row["length"]] * len(full), pa.int64()),
                        pa.array([k] * len(full), pa.int32()), pa.array([i for i, _, _ in full], pa.int32()),
                        pa.array([_squeeze(keys[x:y]) for _, x, y in full], pa.binary()), pa.array([_numbers(counts[x:y]) for _, x, y in full], pa.binary())],
                        names=["file", "offset", "length", "k", "range", "grams", "counts"])

    shape = "file string, offset long, length long, k int, range int, {}"

    def answer(table: pa.Table) -> pa.Table:
        grams = [_unsqueeze(x) for x in table.column("grams").to_pylist()]
        counts = np.concatenate([_read_numbers(x) for x in table.column("counts").to_pylist()])
        keys, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
        cut = np.cumsum([0, *map(len, grams)])
        back = [_numbers(total[place[x:y]]) for x, y in zip(cut, cut[1:])]
        seen = np.zeros(len(grams), np.int64)
        tokens = seen.copy()
        seen[0], tokens[0] = int((total > 0).sum()), int(total.sum())
        out = table.select(["file", "offset", "length", "k", "range"])
        return out.append_column("totals", pa.array(back, pa.binary())).append_column("seen", pa.array(seen)).append_column("tokens", pa.array(tokens))

    asked = blocks.repartition(ranges).mapInArrow(ask, shape.format("grams binary, counts binary"))
    answers = stored(asked.groupBy("k", "range").applyInArrow(answer, shape.format("totals binary, seen long, tokens long")), "answers")
    sums = answers.where("k = 0").agg(F.sum("seen"), F.sum("tokens")).first()
    distinct, train_tokens = int(sums[0] or 0), int(sums[1] or 0)

    def walk(table: pa.Table) -> pa.Table:
        head = table.slice(0, 1).to_pylist()[0]
        b = _tokens(_unpack(head["file"], head["offset"], head["length"]), order)
        parts = sorted(zip(table.column("k").to_pylist(), table.column("range").to_pylist(), table.column("totals").to_pylist()), key=lambda x: x[:2])
        counts, place = [], []
        for k in range(order):
            of_order = [_read_numbers(t) for kk, _, t in parts if kk == k]
            counts.append(np.concatenate(of_order) if of_order else np.zeros(0, np.int64))
            place.append(_ask(b, k)[2].astype(np.int32))
            b.grams[k] = b.grams[k][:0].copy()
        del parts
        n_texts = len(b.first)
        ends = np.append(b.first[1:], len(b.text)) - 1
        train_texts = float(counts[0][place[0][ends[0]]])  # every training text has one end
        lowest = (counts[0] + 1) / (train_tokens + distinct + 1)
        automaton = Automaton.of(b, place, counts, lowest, priors, train_texts)
        del place[1:], counts[1:]
        total = automaton.read(place[0], b.first, order)
        known, base = counts[0][place[0]] > 0, np.log10(lowest)[place[0]]
        add = lambda x: np.bincount(b.text, weights=x, minlength=n_texts)
        size = np.bincount(b.text, minlength=n_texts)
        return pa.table([b.ids, pa.array(b.held), pa.array(size.astype(np.int64)), pa.array(add(known).astype(np.int64)),
                         pa.array(np.full(n_texts, train_tokens, np.int64)), pa.array(add(base)), pa.array(total)],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # Answers are short, so blocks are dealt out by number and not by bytes.
    done = answers.select("file", "offset", "length", "k", "range", "totals").repartition(ranges, "file", "offset").groupBy("file", "offset").applyInArrow(
        walk, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", key)
