"""One row per subject, unique rows and first known values over arriving rows.

A minimum is the same whether it is taken at once or over minima, so the stream only has to leave out rows that cannot
matter any more. Each function returns a stream of the rows that improved what its subject had so far (written in append mode,
for instance with ``cleaning.write_clean``), and the batch operator over the stored rows gives the same as over all rows:

* ``first_rows``    then ``waves.one_per_subject``
* ``unique_rows``   then ``waves.drop_dups``
* ``known_values``  then ``waves.first_entry``

State is one small row per key. ``keep_for`` deletes it when a key has been silent for that many seconds (a timer in processing time);
rows that come later may pass once more, which costs space but never changes the result. A query with such timers always has a next
batch, so ``keep_for`` is for queries that run on, not for ``availableNow``. Before rows are shuffled, each Arrow
batch drops those that lose inside the batch, so a subject with a third of all rows does not send them all to one task.
Null keys are a key; null and NaN orders pass to the comparison of the operator. A stream without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, Row, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the store that keyed state needs


def _rank(value) -> tuple:
    """Spark's order of values: null first, NaN last."""
    if value is None:
        return (0,)
    if isinstance(value, (list, tuple)):
        return 1, tuple(_rank(v) for v in value)
    return (2,) if value != value else (1, value)


class _Improving(StatefulProcessor):
    """Passes the rows that ``judge`` calls an improvement; ``judge(held, row)`` returns the new state, None if the row changes nothing."""

    def __init__(self, judge: Callable, schema: StructType, keep_for: float | None):
        self.judge, self.schema, self.keep_for = judge, schema, keep_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        passed = []
        for row in rows:
            better = self.judge(held, row)
            if better is not None:
                held = better
                passed.append(row)
        if passed:
            self.held.update(held)
        if self.keep_for is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.keep_for * 1000))
        yield from passed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def _improving(stream: DataFrame, keys: Sequence[str], judge: Callable, state: StructType, keep_for: float | None) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(*keys).transformWithState(
        _Improving(judge, state, keep_for), stream.schema, "append", "none" if keep_for is None else "processingTime")


def _batchwise(stream: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows that survive a filter inside their own Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(mask(b)))

    return stream.mapInArrow(run, stream.schema)


def _groups(b: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Number of each row's key inside the batch; null keys are equal."""
    columns = [pc.dictionary_encode(b.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
    return np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].ravel()


def _leading(groups: np.ndarray, order: pa.Array, among: np.ndarray, largest: bool = False) -> np.ndarray:
    """Rows that hold the extreme order of their group, with those whose order is null or NaN."""
    place = pc.rank(order, "descending" if largest else "ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)
    open_ = pc.is_null(order, nan_is_null=True).to_numpy(zero_copy_only=False)
    best = np.full(groups.max() + 1, np.iinfo(np.int64).max)
    known = among & ~open_
    np.minimum.at(best, groups[known], place[known])
    return among & (open_ | (place == best[groups]))


def first_rows(stream: DataFrame, key: str | Sequence[str], select: str = "min", day: str = "day", tiebreak: str = "visit_id",
               lower: int | None = None, keep_for: float | None = None) -> DataFrame:
    """Rows that are the smallest or largest day of their key so far; ties go to the smallest tie-break. Null days are left out."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = stream.where(F.col(day).isNotNull() if lower is None else F.col(day) > lower)
    largest = select != "min"
    rest = [c for c in stream.columns if c not in (*keys, tiebreak)]

    def rank(row: Sequence) -> tuple:
        at = dict(zip(names, row))
        first = -at[day] if largest else at[day]
        return _rank(first), _rank(at[tiebreak]), tuple(_rank(at[c]) for c in rest)

    def judge(held: tuple | None, row: Row) -> tuple | None:
        return tuple(row) if held is None or rank(row) < rank(held) else None

    def mask(b: pa.RecordBatch) -> np.ndarray:
        groups = _groups(b, keys)
        kept = _leading(groups, b.column(day), np.ones(b.num_rows, bool), largest)
        return _leading(groups, b.column(tiebreak), kept)

    names = stream.columns
    return _improving(_batchwise(rows, mask), keys, judge, stream.schema, keep_for)


def unique_rows(stream: DataFrame, key: str, keep_for: float | None = None) -> DataFrame:
    """The first two rows that arrive of each key: a key with one stored row has no copies.

    For ``drop_dups(keep=False)``. With ``keep="first"`` take ``first_rows(select="min", day=order)`` over orders without nulls.
    """
    def judge(held: tuple | None, row: Row) -> tuple | None:
        seen = held[0] if held else 0
        return (seen + 1,) if seen < 2 else None

    def mask(b: pa.RecordBatch) -> np.ndarray:
        groups = pd.Series(_groups(b, [key]))
        return (groups.groupby(groups).cumcount() < 2).to_numpy()

    return _improving(_batchwise(stream, mask), [key], judge, StructType([StructField("seen", IntegerType())]), keep_for)


def known_values(stream: DataFrame, key: str, order: str, cols: Sequence[str], keep_for: float | None = None) -> DataFrame:
    """Rows that hold the first known value so far of any of the columns, in the given order (equal orders: the smallest value)."""
    picked = stream.select(*dict.fromkeys([key, order, *cols]))
    kinds = {f.name: f.dataType for f in picked.schema.fields}
    state = StructType([f for i, c in enumerate(cols) for f in (
        StructField(f"known{i}", BooleanType()), StructField(f"order{i}", kinds[order]), StructField(f"value{i}", kinds[c]))])

    def judge(held: tuple | None, row: Row) -> tuple | None:
        best = list(held) if held else [False, None, None] * len(cols)
        better = False
        for i, c in enumerate(cols):
            known, at, value = best[3 * i:3 * i + 3]
            if row[c] is not None and (not known or (_rank(row[order]), _rank(row[c])) < (_rank(at), _rank(value))):
                best[3 * i:3 * i + 3] = True, row[order], row[c]
                better = True
        return tuple(best) if better else None

    def mask(b: pa.RecordBatch) -> np.ndarray:
        groups = _groups(b, [key])
        kept = np.zeros(b.num_rows, bool)
        for c in cols:
            kept |= _leading(groups, b.column(order), pc.is_valid(b.column(c)).to_numpy(zero_copy_only=False))
        return kept

    return _improving(_batchwise(picked, mask), [key], judge, state, keep_for)
