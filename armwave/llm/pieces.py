"""SentencePiece segmentation by one forward pass over a trie of distinct words.

Texts are cut at spaces into marked words (a run of spaces and what follows). The distinct words of a slice that are
not known yet are sorted, which makes neighbours in the order share prefixes, and walked depth first: the forward
state of a prefix (what its best segmentation ends with) is computed once for all words that share it.

For unigram models the state is the best sum of piece scores. For BPE models adding up scores would not give the model's
own segmentation; there a state is the last piece of the prefix's only valid segmentation: one in which no two
neighbouring pieces would have been merged across their border. Both give the library's ids.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.llm.textbytes import RangeHash, text_slices

MARK = "▁"
KNOWN_WORDS = 250_000  # words whose ids a task remembers; beyond that it starts over
KNOWN_PAIRS = 400_000  # ... and pairs of pieces found to stay apart or not
NEVER = 1 << 60
PIECE_NORMAL, PIECE_UNKNOWN, PIECE_CONTROL, PIECE_USER, PIECE_BYTE = 1, 2, 3, 4, 6


@dataclass
class Vocabulary:
    """Pieces of a model file: strings, scores, kinds; for BPE also the order of merges and each piece's last merge."""

    piece: list[str]
    score: list[float]
    kind: list[int]
    unigram: bool
    rank: dict[str, int] = field(default_factory=dict)
    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    id_of: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, model: bytes) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        v = cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 1)
        v.id_of = {p: i for i, p in enumerate(v.piece) if v.kind[i] in (PIECE_NORMAL, PIECE_USER)}
        if any(MARK in p.lstrip(MARK) for p in v.id_of) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in v.id_of):
            raise ValueError("pieces that cross a space are not supported")
        if not v.unigram:
            runs = [p for p in v.id_of if not p.strip(MARK)]
            plain = sorted((p for p in v.id_of if p.strip(MARK)), key=lambda p: -v.score[v.id_of[p]])
            long = [p for p in plain if len(p) > 1]
            if len({v.score[v.id_of[p]] for p in long}) < len(long):
                raise ValueError("merges of equal score are not supported")
            v.rank = {p: i for i, p in enumerate(long)}
            for p in long:
                last = v.merged(p)
                if last is None:  # never reached by merges
                    del v.id_of[p]
                else:
                    v.split[v.id_of[p]] = (v.id_of[last[0]], v.id_of[last[1]])
            v.rank = {p: r for p, r in v.rank.items() if p in v.id_of}
            v.runs = {len(p): v.id_of[p] for p in runs}
        return v

    def merged(self, word: str) -> tuple[str, str] | None:
        """The merge that completes a piece, or None if merges do not lead to it."""
        parts = list(word)
        last = None
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            if best[0] == NEVER:
                return None
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return last


class Segmenter:
    """Ids of marked words; made once per task from a vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.auto = ahocorasick.Automaton()
        for p, i in v.id_of.items():
            if not v.unigram and len(p) > 1 and not p.strip(MARK):
                continue
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.longest = max(map(len, v.id_of))
        self.chars = {p for p in v.id_of if len(p) == 1}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(v.piece) if v.kind[i] == PIECE_BYTE}
        self.unknown = v.kind.index(PIECE_UNKNOWN)
        self.order = [NEVER] * len(v.piece)
        for i, p in enumerate(v.piece):
            self.order[i] = v.rank.get(p, -1)
        self.pairs: dict[int, bool] = {}
        self.sizes = [len(p) for p in v.piece]
        self.runs: dict[int, list[int]] = {}
        self.lowest = min((s for s, k in zip(v.score, v.kind) if k == PIECE_NORMAL), default=0.0) - 10.0

    def _apart(self, x: int, y: int) -> bool:
        """True if no merge joins the end of piece x with the start of piece y before both are complete."""
        order, split, piece, rank = self.order, self.v.split, self.v.piece, self.v.rank
        limit = NEVER
        while True:
            if rank.get(piece[x] + piece[y], NEVER) < limit:
                return False
            rx, ry = order[x], order[y]
            if rx > ry:
                limit, x = rx, split[x][1]
            elif ry >= 0:
                limit, y = ry + 1, split[y][0]
            else:
                return True

    def _bytes(self, text: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in text.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of sorted words of known characters; each starts with at most one mark."""
        last: list[int] = [0]
        total: list[float] = [0.0]
        before, pairs, unigram, score, sizes = "", self.pairs, self.v.unigram, self.v.score, self.sizes
        matches, reach, apart = self.auto.iter, self.longest - 1, self._apart
        if len(pairs) > KNOWN_PAIRS:
            pairs.clear()
        for word in words:
            length = len(word)
            shared, most = 0, min(length, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], total[shared + 1:]
            last += [-1] * (length - shared)
            for end, (size, i) in matches(word, shared - reach if shared > reach else 0):
                if end < shared:
                    continue
                end += 1
                if unigram:
                    s = total[end - size] + score[i]
                    if len(total) == end:
                        total.append(s)
                        last[end] = i
                    elif s > total[end]:
                        total[end], last[end] = s, i
                elif last[end] < 0:
                    if end == size:
                        last[end] = i
                        continue
                    x = last[end - size]
                    key = x << 32 | i
                    if key in pairs:
                        ok = pairs[key]
                    else:
                        ok = pairs[key] = apart(x, i)
                    if ok:
                        last[end] = i
            before = word
            out, at = [], length
            while at:
                i = last[at]
                out.append(i)
                at -= sizes[i]
            out.reverse()
            yield out

    def _run(self, n: int) -> list[int]:
        """Ids of a run of marks: all its merges have one score, so the leftmost possible one comes first."""
        if n not in self.runs:
            size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            queue = [(i, 1, 1) for i in range(n - 1)]  # already a heap
            while queue:
                i, a, b = heapq.heappop(queue)
                j = after[i]
                if size[i] != a or j >= n or size[j] != b or a + b not in self.v.runs:
                    continue
                size[i], size[j], after[i] = a + b, 0, after[j]
                if after[j] < n:
                    before[after[j]] = i
                    heapq.heappush(queue, (i, a + b, size[after[j]]))
                if before[i] >= 0:
                    heapq.heappush(queue, (before[i], size[before[i]], a + b))
            self.runs[n] = [self.v.runs[k] for k in size if k]
        return self.runs[n]

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of distinct marked words (with spaces as marks), in the order given."""
        odd = set("".join(units)) - self.chars
        plain, rest = [], []
        for j, u in enumerate(units):
            # Marks in front of the last one never join a word, and alone they follow a rule of their own.
            simple = self.v.unigram or (u[:1] != MARK or (len(u) > 1 and u[1] != MARK))
            (plain if simple and (not odd or odd.isdisjoint(u)) else rest).append(j)
        plain.sort(key=units.__getitem__)
        out: list[list[int]] = [[]] * len(units)
        for j, ids in zip(plain, self.words([units[j] for j in plain])):
            out[j] = ids
        for j in rest:
            out[j] = self._pieces(units[j])
        return out

    def _pieces(self, unit: str) -> list[int]:
        """Ids of a word with several marks, only marks, or characters without a piece (their bytes)."""
        marks = 0 if self.v.unigram else len(unit) - len(unit.lstrip(MARK))
        if marks == len(unit):
            return self._run(marks)
        ids: list[int] = []
        for known, part in groupby(unit[marks - 1:] if marks else unit, self.chars.__contains__):
            text = "".join(part)
            if known:
                ids += next(self.words([text]))
            else:
                for ch in text:
                    ids += self._bytes(ch)
        if marks > 1:  # a mark that no merge took joins the run before it
            ids = self._run(marks) + ids[1:] if self.v.piece[ids[0]] == MARK else self._run(marks - 1) + ids
        return ids


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, unit starts, unit ends, units per text); a text that is not empty gets a space in front."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ").cast(pa.large_binary())
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary())))
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = buf == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inner] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(buf)) if len(start) else start
    return buf, start, end, np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])


def _piece_bytes(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the pieces stand for, as one array, and where each ends."""
    table = []
    for p, k in zip(v.piece, v.kind):
        table.append(bytes([int(p[1:-1], 16)]) if k == PIECE_BYTE else " ⁇ ".encode() if k == PIECE_UNKNOWN else b"" if k == PIECE_CONTROL
                     else p.replace(MARK, " ").encode())
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def _spelled(ids: np.ndarray, edge: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lists of ids that end at ``edge``, and where each list's bytes end."""
    size = (ends[1:] - ends[:-1])[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(total[-1]) - np.repeat(total[:-1] - ends[ids], size)], total[edge]


class _Words:
    """Ids of the words a task has met, as one flat array."""

    def __init__(self, segmenter: Segmenter) -> None:
        self.segmenter, self.hash = segmenter, RangeHash(31)
        self.bytes, self.byte_ends = _piece_bytes(segmenter.v)
        self.code: dict[int, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of each text, and whether its pieces' bytes are the text's (marks reading as spaces)."""
        buf, start, end, per_text = _units(texts)
        value, first, back = np.unique(self.hash.ranges(self.hash.sums(buf), start, end), return_index=True, return_inverse=True)
        if len(self.code) + len(value) > KNOWN_WORDS and self.code:
            self.code, self.flat, self.ends = {}, array("i"), array("q", [0])
        keys = value.tolist()
        fresh = [j for j, k in enumerate(keys) if k not in self.code]
        raw = buf.tobytes()
        for j, ids in zip(fresh, self.segmenter.encode([raw[start[first[j]]: end[first[j]]].decode("utf-8", "surrogatepass").replace(" ", MARK) for j in fresh])):
            self.code[keys[j]] = len(self.code)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        code = np.array([self.code[k] for k in keys], dtype=np.int64)[back] if len(keys) else np.zeros(0, np.int64)
        ends = np.array(self.ends, dtype=np.int64)
        size = ends[code + 1] - ends[code]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(total[-1]) - np.repeat(total[:-1] - ends[code], size)
        ids = np.array(self.flat, dtype=np.int32)[at]
        edge = total[np.concatenate(([0], np.cumsum(per_text)))]
        raw, ends = _spelled(ids, edge, self.bytes, self.byte_ends)
        if len(raw) == len(buf) and (raw == buf).all():
            same = np.ones(len(texts), bool)
        else:
            unit = np.concatenate(([0], np.cumsum(per_text)))
            own = np.append(start, len(buf))[unit]
            same = np.array([raw[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(ends, ends[1:], own, own[1:])], dtype=bool)
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)), same


def load(spark, path: str):
    """The vocabulary of a model file, sent to the executors once (a megabyte or two, by the file's size)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Vocabulary.read(f.read()))


def encode(docs: DataFrame, model, text: str = "text", out: str = "piece_ids", round_trip: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text. Null gives null, an empty text no ids. No shuffle; whole texts.

    A character without a piece gives its UTF-8 bytes (or the unknown id). ``round_trip`` names a further column: whether
    the ids, decoded at once, read as the text up to marks (true for null). Columns named like the new ones are replaced.
    """
    names = [c for c in docs.columns if c not in (out, round_trip)]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    if dict(docs.dtypes)[text] != "string":
        raise ValueError(f"{text} is no text column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(Segmenter(model.value))
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), text)
            for first, part in text_slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
                t = part.column("t")
                ids, same = words.encode(t)
                if t.null_count:
                    ids = pc.if_else(t.is_valid(), ids, pa.scalar(None, ids.type))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, len(t)), ids, pa.array(same)], names=["row", "ids", "same"])

    done = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, same boolean")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("ids").alias(out), *([F.col("same").alias(round_trip)] if round_trip else []))


def decode(df: DataFrame, model, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list; the inverse of :func:`encode` up to the mark character, which reads as a space.

    Null gives null. Control pieces give nothing, the unknown piece its usual sign, bytes that are no UTF-8 a replacement sign.
    """
    names = [c for c in df.columns if c != out]
    packed = df.select(F.col(f"`{ids}`").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ends = _piece_bytes(model.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column("ids")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                spelled, edge = _spelled(code, np.concatenate(([0], np.cumsum(sizes))), flat, ends)
                raw = spelled.tobytes()
                texts = []
                for ok, a, b in zip(lists.is_valid().to_pylist(), edge[:-1].tolist(), edge[1:].tolist()):
                    texts.append((raw[a + (raw[a: a + 1] == b" "): b]).decode("utf-8", "replace") if ok else None)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "t"])

    done = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, t string")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("t").alias(out))
