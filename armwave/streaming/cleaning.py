"""Cleaning of arriving questionnaire rows.

The analyses are batch work: nothing here keeps state, so no watermark is needed. Filters, casts,
missing codes, windows of a row and the join to the (static) arm table apply to a stream unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from armwave.operators.columns import cast_base, null_codes
from armwave.operators.filters import collapse_rater, exclude
from armwave.operators.joins import attach_arm
from armwave.operators.waves import CUTS, split_waves


def clean_rows(rows: DataFrame, arms: DataFrame, codes: Sequence, key: str = "src_subject_id", rater: str = "version_form",
               day: str = "days_baseline", cuts: Mapping[str, int] = CUTS, without: Sequence[str] = ("L",)) -> DataFrame:
    """Missing codes, base types, arm, rater label and cumulative windows; works on batch and stream."""
    scores = [c for c in rows.columns if c not in (key, rater, day)]
    cleaned = cast_base(null_codes(rows, codes, cols=scores))
    joined = exclude(attach_arm(cleaned, arms, key), "trtname", without)
    return split_waves(collapse_rater(joined, rater), cuts, day)


def write_clean(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the cleaned rows as Parquet; with ``availableNow=True`` it stops when all files are read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
