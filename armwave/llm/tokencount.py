"""Lengths of greedy word-piece segmentations without building pieces.

The vocabulary is a trie over bytes. Where a word leaves the trie, the failure link of a node leads to the node for what
greedy longest matching has left of the node's string, and the number of pieces popped on the way is
precomputed. A word so takes one step per byte plus one per failure link, whatever the length of the pieces.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.llm.textbytes import RangeHash, text_slices, texts_of, words_of

KNOWN_WORDS = 1_000_000  # words whose counts a task remembers; beyond that it starts over


class LongestMatch:
    """Longest-match automaton of byte strings; every single byte must be one of them, so that matching cannot fail."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.step: dict[int, int] = {}
        end, parent, byte = [False], [0], [0]
        for token in tokens:
            node = 0
            for b in token:
                at = node << 8 | b
                if at not in self.step:
                    self.step[at] = len(end)
                    end.append(False)
                    parent.append(node)
                    byte.append(b)
                node = self.step[at]
            end[node] = node != 0
        self.fail, self.popped = [-1] * len(end), [0] * len(end)
        children: list[list[int]] = [[] for _ in end]
        for node in range(1, len(end)):
            children[parent[node]].append(node)
        queue = deque(children[0])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            if end[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            up = parent[node]
            left, popped = self.fail[up], self.popped[up]
            while left >= 0 and (left << 8 | byte[node]) not in self.step:
                popped += self.popped[left]
                left = self.fail[left]
            if left < 0:
                raise ValueError(f"no single-byte piece for {byte[node]}")
            self.fail[node], self.popped[node] = self.step[left << 8 | byte[node]], popped

    def count(self, word: bytes) -> int:
        step, fail, popped, node, n = self.step, self.fail, self.popped, 0, 0
        for b in word:
            at = step.get(node << 8 | b)
            while at is None:
                n += popped[node]
                node = fail[node]
                at = step.get(node << 8 | b)
            node = at
        while node:
            n += popped[node]
            node = fail[node]
        return n


_BUILT: dict[str, LongestMatch] = {}


def byte_vocabulary(path: str) -> list[bytes]:
    """Byte strings of a byte-level vocabulary file, whose characters stand for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [bytes(byte[c] for c in token) for token in model["model"]["vocab"] if token not in special]


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_tokens) per row: pieces of greedy longest matching over a space and each word ``[^\\x20\\x09-\\x0D]+``.

    Null and empty texts have 0. The vocabulary (its file's size, some 50,000 strings) is sent to the executors.
    Rows with null or repeated keys are kept; other columns are not read.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(byte_vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()
    missing = [b for b in range(256) if bytes([b]) not in set(tokens.value)]
    if missing:
        raise ValueError(f"bytes without a piece: {missing[:5]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _BUILT:
            _BUILT[path] = LongestMatch(tokens.value)
        auto, h, known = _BUILT[path], RangeHash(51), {}
        for batch in batches:
            for _, part in text_slices(batch, "t"):
                t = texts_of(part, "t")
                w = words_of(t)
                value, first, back = np.unique(h.ranges(h.sums(t.buf), w.start, w.end), return_index=True, return_inverse=True)
                if len(known) + len(value) > KNOWN_WORDS:
                    known.clear()
                raw, keys = t.buf.tobytes(), value.tolist()
                for k, at in zip(keys, first.tolist()):
                    if k not in known:
                        known[k] = auto.count(b" " + raw[w.start[at]: w.end[at]])
                count = np.array([known[k] for k in keys], dtype=np.int64)[back] if keys else np.zeros(0, np.int64)
                n = np.bincount(w.text, weights=count, minlength=t.n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(w.count.astype(np.int64)), pa.array(n)], names=[key, "n_words", "n_tokens"])

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long")
