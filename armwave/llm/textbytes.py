"""Arrow text columns as numpy bytes: words, lines, and position-independent hashes of byte ranges.

All helpers work on slices of a record batch that hold about half a megabyte of text (a longer text is a
slice of its own), so a task's memory depends on the longest text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array of hashes."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RangeHash:
    """Hashes of byte ranges that do not depend on where a range lies: one running sum, two lookups a range."""

    def __init__(self, salt: int, lower: bool = False) -> None:
        self.table = mix(np.arange(256, dtype=_U), salt)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.base = int(mix(np.array([salt], dtype=_U), 77)[0]) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n + n // 8, base % 2**64, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, buf: np.ndarray) -> np.ndarray:
        return self.sums_of(self.table[buf])

    def sums_of(self, values: np.ndarray) -> np.ndarray:
        """As ``sums`` over units that are hashes themselves."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverses[start], 1) ^ mix((end - start).astype(_U), 2)

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all byte strings of one width, by start."""
        n = len(sums) - width
        return mix((sums[width:] - sums[:n]) * self.inverses[:n], 1) if n > 0 else np.zeros(0, dtype=_U)


def text_slices(batch: pa.RecordBatch, *columns: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, slice) pieces of a batch with about ``limit`` bytes of text each (of all named columns)."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield first, batch.slice(first, last - first)
        first = last


@dataclass
class Texts:
    """Bytes of a slice; every text is followed by one newline that belongs to no text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)


def texts_of(batch: pa.RecordBatch, column: str) -> Texts:
    """Texts as UTF-8 bytes; a null text counts as empty."""
    values = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset: values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]: offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    if values.null_count:
        gone = ~values.is_valid().to_numpy(zero_copy_only=False)
        if sizes[gone].any():
            data = data[np.repeat(~gone, sizes)]
        sizes = np.where(gone, 0, sizes)
    end = np.cumsum(sizes + 1) - 1
    buf = np.full(int(sizes.sum()) + len(sizes), 10, dtype=np.uint8)
    keep = np.ones(len(buf), dtype=bool)
    keep[end] = False
    buf[keep] = data
    return Texts(buf, end - sizes, end)


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte range, text, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    count: np.ndarray


def words_of(t: Texts) -> Words:
    gap = (t.buf == 32) | ((t.buf >= 9) & (t.buf <= 13))
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    text = np.searchsorted(t.start, start, side="right") - 1
    count = np.bincount(text, minlength=t.n) if len(text) else np.zeros(t.n, dtype=np.int64)
    return Words(start, end, text, np.cumsum(count) - count, count)


def per_text(flags_at: np.ndarray, t: Texts) -> np.ndarray:
    """How many of the given byte positions lie in each text."""
    return np.searchsorted(flags_at, t.end) - np.searchsorted(flags_at, t.start)


def word_runs(hashes: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(words.text[:n] == words.text[width - 1:])
    out = np.zeros(len(at), dtype=_U)
    for k in range(width):
        out = out * _U(0xD1342543DE82EF95) + hashes[at + k]
    return at, mix(out, width)
