"""Streams over files in three parts against the batch operators, and state that is deleted by a timer."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armwave.operators import waves
from armwave.streaming import cleaning, subjects

SCHEMA = "visit_id long, subject string, day int, score double, note string"


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def parts(spark, folder, n=240):
    """Three files; a third of all rows is one subject; null subjects, null days, tied days and repeated rows."""
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"visit_id": rng.permutation(n), "subject": [f"s{i}" for i in rng.integers(0, 40, n)], "day": rng.integers(0, 30, n)}).astype(object)
    rows.loc[:n // 3, "subject"] = "hot"
    rows.loc[n - 8:, "subject"] = None
    rows["score"] = pd.Series([None if i % 3 else float(i) for i in rng.integers(0, 50, n)], dtype=object)
    rows["note"] = pd.Series([None if i % 2 else f"n{i}" for i in rng.integers(0, 50, n)], dtype=object)
    rows.loc[::11, "day"] = None
    rows.loc[n - 40:n - 35] = rows.loc[:5].to_numpy()
    rows = rows.sample(frac=1, random_state=1)
    for i in range(3):
        part = [tuple(r) for r in rows.iloc[i::3].itertuples(index=False)]
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(str(folder))
    return str(folder)


def streamed(spark, folder, tmp_path, build, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)
    out = str(tmp_path / "out")
    cleaning.write_clean(build(stream), out, str(tmp_path / "ckpt"), **options).awaitTermination(300)
    return spark.read.parquet(out)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = {
    "first": (lambda s: subjects.first_rows(s, "subject"), lambda d: waves.one_per_subject(d, "subject")),
    "last": (lambda s: subjects.first_rows(s, "subject", "max"), lambda d: waves.one_per_subject(d, "subject", "max")),
    "after": (lambda s: subjects.first_rows(s, "subject", lower=9), lambda d: waves.one_per_subject(d, "subject", lower=9)),
    "unique": (lambda s: subjects.unique_rows(s, "subject"), lambda d: waves.drop_dups(d, "subject", "visit_id")),
    "known": (lambda s: subjects.known_values(s, "subject", "day", ["score", "note"]), lambda d: waves.first_entry(d, "subject", "day", ["score", "note"])),
}


@pytest.mark.parametrize("name", list(CASES))
def test_stream_in_three_parts_is_the_batch(spark, tmp_path, name):
    build, batch = CASES[name]
    folder = parts(spark, tmp_path / "in")
    stored = streamed(spark, folder, tmp_path, build)
    whole = spark.read.schema(SCHEMA).parquet(folder)
    got, want = rows_of(batch(stored)), rows_of(batch(whole))
    if name == "known":  # subjects without any known value have no stored row
        want = [r for r in want if any(v is not None for v in r[1:])]
    assert want and got == want
    assert stored.count() < whole.count() / 2


def test_silent_keys_are_deleted_by_their_timer(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def add(*row):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def wait(n, seconds=60):
        end = time.time() + seconds
        while time.time() < end and not ((tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema(SCHEMA).parquet(out).count() >= n):
            time.sleep(0.5)
        return spark.read.schema(SCHEMA).parquet(out)

    add(1, "a", 5, None, None)
    stream = subjects.first_rows(spark.readStream.schema(SCHEMA).parquet(folder), "subject", keep_for=1)
    running = cleaning.write_clean(stream, out, str(tmp_path / "ckpt"), processingTime="1 second")
    try:
        assert wait(1).count() == 1
        time.sleep(8)  # batches without rows go on, and the state of a goes
        add(2, "a", 9, None, None)
        stored = wait(2)
        assert rows_of(stored.select("visit_id")) == [(1,), (2,)]  # the later row passes again
    finally:
        running.stop()
    assert rows_of(waves.one_per_subject(stored, "subject").select("subject", "visit_id")) == [("a", 1)]


def test_an_empty_stream_has_no_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    out = str(tmp_path / "out")
    cleaning.write_clean(subjects.known_values(stream, "subject", "day", ["score"]), out, str(tmp_path / "ckpt")).awaitTermination(120)
    assert spark.read.schema("subject string").parquet(out).count() == 0
