"""Fill-in-middle transformation of texts that are kept as seekable compressed frames.

A text becomes independent zstandard frames of bounded size, with the units (lines) and code points that come before
each frame. The cuts of a document are numbers of units, drawn from its key: the cumulative counts name the frame
that holds a cut, and only this frame is decompressed to find the byte. The output is a list of frames again: frames without a
cut go over as they are, halves of cut frames and the marks become frames of their own. Digests stream frames in
order, so a task holds one row in compressed form and one frame of plain bytes, however long a text is.

Units are lines, ``[^\\n]*\\n|[^\\n]+``. A null text counts as empty. A null key draws like an empty one. Rows that
repeat a key draw the same cuts. Frames are cut at any byte, code points are counted by their first byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.llm.graph import stored

FRAME_BYTES = 1 << 16
BATCH_BYTES = 1 << 20   # of frames in a batch that a task hands on
LEVEL = 3
# The marks of the three parts, and the order of the parts in each form.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
_FRAMED = "frames array<binary>, units array<long>, chars array<long>, marked boolean"


def _chars(data: bytes) -> int:
    """Code points that begin in these bytes."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def _batches(rows: Iterable[tuple[pa.RecordBatch, tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (kept columns as a batch of one row, further values, bytes) gathered to batches of bounded size."""
    kept: list[pa.RecordBatch] = []
    made: list[tuple] = []
    size = 0

    def full() -> pa.RecordBatch:
        own = pa.Table.from_batches(kept).combine_chunks().columns
        own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
        more = [pa.array(x, f.type) for x, f in zip(zip(*made), list(schema)[len(own):])]
        return pa.RecordBatch.from_arrays([*own, *more], schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(schema, [*own, *more])]))

    for own, values, n in rows:
        kept.append(own)
        made.append(values)
        size += n
        if size >= BATCH_BYTES or len(kept) >= 4096:
            yield full()
            kept, made, size = [], [], 0
    if kept:
        yield full()


def _schema(own: pa.Schema, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([*own, *[pa.field(n, t) for n, t in more]])


def framed(docs: DataFrame, text: str = "text", key: str = "doc_id", frame: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """(row, key, frames, units, chars, marked) for every row, written to the shared folder.

    ``row`` holds the other columns. ``units`` and ``chars`` have one number per frame, what comes before it, and the
    totals at the end. ``marked`` says that the text holds one of the marks. An empty text has no frame.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.col(f"`{text}`").isNull().alias("_no_text")).alias("row"), F.col(f"`{key}`").cast("string").alias("key"), t.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        schema = None

        def each(batch: pa.RecordBatch):
            own = batch.select(["row", "key"])
            for i, value in enumerate(batch.column("t").cast(pa.large_binary())):
                data = value.as_buffer()
                pieces, units, chars = [], [0], [0]
                whole = memoryview(data)
                for at in range(0, len(whole), frame):
                    part = bytes(whole[at: at + frame])
                    pieces.append(press.compress(part))
                    units.append(units[-1] + part.count(b"\n"))
                    chars.append(chars[-1] + _chars(part))
                if len(whole) and whole[-1] != 10:  # the last line has no line end
                    units[-1] += 1
                text_bytes = value.as_py()
                yield own.slice(i, 1), (pieces, units, chars, any(m in text_bytes for m in MARKS.values())), sum(map(len, pieces))

        for batch in batches:
            schema = schema or _schema(batch.select(["row", "key"]).schema, ("frames", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("marked", pa.bool_()))
            yield from _batches(each(batch), schema)

    shape = f"row {rows.schema['row'].dataType.simpleString()}, key string, {_FRAMED}"
    return stored(rows.mapInArrow(run, shape), "frames", "none")


def draws(seed: int, key: str | None) -> list[int]:
    """Four unsigned 32-bit numbers: the first groups of the hex sha256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
    return [int(digest[i: i + 8], 16) for i in range(0, 32, 8)]


class Seeker:
    """The frames of one text with their cumulative counts; decompresses a frame when a cut or a stream needs it."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], unpress: zstandard.ZstdDecompressor) -> None:
        self.frames, self.units, self.chars, self.unpress = frames, units, chars, unpress
        self.opened = 0

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, bytes into it, code points before) of the end of the first ``unit`` units."""
        if unit == 0:
            return 0, 0, 0
        if unit >= self.units[-1]:
            return len(self.frames), 0, self.chars[-1]
        # The unit-th line end lies in the first frame after which that many units are over.
        at = int(np.searchsorted(self.units, unit, side="left")) - 1
        data = self.unpress.decompress(self.frames[at])
        self.opened += 1
        end = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[unit - self.units[at] - 1]) + 1
        return at, end, self.chars[at] + _chars(data[:end])

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int], press: zstandard.ZstdCompressor) -> list[bytes]:
        """Frames of the bytes between two places; whole frames are taken over as they are."""
        out, (a, x, _), (b, y, _) = [], start, end
        while a < b or (a == b and x < y):
            if x == 0 and a < b:
                out.append(self.frames[a])
            else:
                part = self.unpress.decompress(self.frames[a])[x: y if a == b else None]
                self.opened += 1
                if part:
                    out.append(press.compress(part))
            a, x = a + 1, 0
        return out


def transform(frames: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, level: int = LEVEL) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) per row of :func:`framed`; ``output`` is a list of frames.

    With h1 to h4 of :func:`draws`: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.
    ``rate`` percent of the texts are cut (h3), ``spm`` percent of them in the form spm (h4), the others as psm; texts that are
    empty or hold a mark stay plain, with null counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=level, write_checksum=True), zstandard.ZstdDecompressor()
        marks = {k: press.compress(v) for k, v in MARKS.items()}
        schema = None

        def each(batch: pa.RecordBatch):
            own = batch.select(["row"])
            keys, marked = batch.column("key"), batch.column("marked")
            for i in range(batch.num_rows):
                pieces, units, chars = (batch.column(c)[i].as_py() for c in ("frames", "units", "chars"))
                n = units[-1]
                h1, h2, h3, h4 = draws(seed, keys[i].as_py())
                if not pieces or marked[i].as_py() or h3 % 100 >= rate:
                    yield own.slice(i, 1), (n, "plain", None, None, pieces), sum(map(len, pieces))
                    continue
                form = "spm" if h4 % 100 < spm else "psm"
                text = Seeker(pieces, units, chars, unpress)
                low, high = text.place(min(h1 % (n + 1), h2 % (n + 1))), text.place(max(h1 % (n + 1), h2 % (n + 1)))
                parts = {"prefix": ((0, 0, 0), low), "middle": (low, high), "suffix": (high, (len(pieces), 0, chars[-1]))}
                out = [f for name in ORDERS[form] for f in (marks[name], *text.between(*parts[name], press))]
                yield own.slice(i, 1), (n, form, low[2], high[2] - low[2], out), sum(map(len, out))

        for batch in batches:
            schema = schema or _schema(batch.select(["row"]).schema, ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary())))
            yield from _batches(each(batch), schema)

    kind = frames.schema["row"].dataType.simpleString()
    return frames.mapInArrow(run, f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def _marks_at(frames: list[bytes], form: str, unpress: zstandard.ZstdDecompressor) -> tuple[dict[str, int], int]:
    """Byte where each mark begins in an output, and its length; marks may lie across frames."""
    found: dict[str, int] = {}
    tail, done = b"", 0
    for f in frames:
        data = tail + unpress.decompress(f)
        for name, mark in MARKS.items():
            if name not in found and (at := data.find(mark)) >= 0:
                found[name] = done - len(tail) + at
        done += len(data) - len(tail)
        tail = data[-2:]
    return found, done


def rebuilt(frames: list[bytes], form: str, unpress: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The original text of an output, as a stream of bytes, from nothing but the output and its form."""
    if form == "plain":
        yield from map(unpress.decompress, frames)
        return
    at, size = _marks_at(frames, form, unpress)
    order = ORDERS[form]
    ends = {name: at[after] for name, after in zip(order, order[1:])} | {order[-1]: size}
    starts = {name: at[name] + len(MARKS[name]) for name in order}
    lengths = [zstandard.frame_content_size(f) for f in frames]
    begins = np.cumsum([0, *lengths])
    for name in ("prefix", "middle", "suffix"):
        a, b = starts[name], ends[name]
        for i in range(max(0, int(np.searchsorted(begins, a, side="right")) - 1), len(frames)):
            if begins[i] >= b:
                break
            yield unpress.decompress(frames[i])[max(0, a - int(begins[i])): b - int(begins[i])]


def digests(out: DataFrame) -> DataFrame:
    """The columns of :func:`transform` without the output, with output_sha256 and restored_sha256 (lower-case hex).

    Output frames are streamed in order; the restored text is streamed from the output and its form.
    """
    keep = [c for c in out.columns if c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            written, restored = [], []
            forms = batch.column("form")
            for i, frames in enumerate(batch.column("output")):
                frames, form = frames.as_py(), forms[i].as_py()
                whole, text = hashlib.sha256(), hashlib.sha256()
                for f in frames:
                    whole.update(unpress.decompress(f))
                for part in rebuilt(frames, form, unpress):
                    text.update(part)
                written.append(whole.hexdigest())
                restored.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(written, pa.string()), pa.array(restored, pa.string())],
                                             names=[*keep, "output_sha256", "restored_sha256"])

    shape = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in keep)
    return out.mapInArrow(run, f"{shape}, output_sha256 string, restored_sha256 string")


def texts(out: DataFrame, column: str = "output_text", frames: str = "output") -> DataFrame:
    """Add the output as text. For rows whose text fits in a cell of the table."""
    names = [*out.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            made = [b"".join(map(unpress.decompress, v.as_py())).decode() for v in batch.column(frames)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(run, f"{shape}, `{column}` string")
