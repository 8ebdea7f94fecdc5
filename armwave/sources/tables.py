"""Readers: questionnaires with a description record, dictionaries, folders, JSON fields, JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: id cell of the description record that follows the header.
DESCRIPTION_ID = "Subject ID how it's defined in lab/project"


def _raw(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    """All columns as text: no inference pass over the data."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    return reader.csv(path if isinstance(path, str) else list(path))


def read_questionnaire(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                       id_col: str = "src_subject_id", day_col: str = "days_baseline",
                       date_col: str | None = "interview_date", sep: str = "\t", described: str = "first") -> DataFrame:
    """Tab-separated table without its description record; null days and exact duplicates dropped.

    The description is the first record of every file, whatever it says; ``described="marked"`` is for tables
    written in several parts, where only the record with the known id cell describes.
    """
    raw = _raw(spark, path, sep)
    if described == "marked":
        kept = raw.where(F.col(id_col).isNull() | (F.col(id_col) != DESCRIPTION_ID))
    else:
        kept = _without(raw, _first_records(spark, raw, sep))
    if columns is not None:
        kept = kept.select(*columns)
    if date_col is not None and date_col in kept.columns:
        kept = kept.withColumn(date_col, F.try_to_date(F.col(date_col), "MM/dd/yyyy"))
    return kept.dropna(subset=[day_col]).dropDuplicates()


def _first_records(spark: SparkSession, raw: DataFrame, sep: str) -> DataFrame:
    """The first record after the header of every file (a row per file)."""
    rows = [_raw(spark, f, sep).first() for f in sorted(raw.inputFiles())]
    return spark.createDataFrame([tuple(r[c] if c in r.asDict() else None for c in raw.columns) for r in rows if r is not None],
                                 ", ".join(f"`{c}` string" for c in raw.columns))


def _without(raw: DataFrame, records: DataFrame) -> DataFrame:
    """Rows that are none of a few records."""
    same = None
    for c in raw.columns:
        test = F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
        same = test if same is None else same & test
    return raw.alias("l").join(records.alias("r"), same, "left_anti")


def read_dictionary(spark: SparkSession, path: str, id_col: str = "src_subject_id", sep: str = "\t", described: str = "first") -> DataFrame:
    """(column, description) pairs from the description record (see :func:`read_questionnaire`)."""
    raw = _raw(spark, path, sep)
    described = raw.where(F.col(id_col) == DESCRIPTION_ID) if described == "marked" else _first_records(spark, raw, sep)
    return described.unpivot([], raw.columns, "column", "description").dropDuplicates(["column"])


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Comma-separated or Parquet table without a saved index column."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else _raw(spark, path, sep)
    return df.drop("Unnamed: 0", "_c0")


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder (path, table, bytes); contents are not read, hidden files are skipped."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", F.col("length").alias("bytes"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file", name).where(~F.col("file").rlike(r"^[._]")).withColumn(
        "table", F.regexp_extract("file", r"^([^0_.]+)", 1)
    )


def read_folder(spark: SparkSession, folder: str, sep: str = ",") -> DataFrame:
    """Every file of a folder, unioned by name, with the table name taken from the file prefix.

    One scan per table; the file list (not the data) is read on the driver.
    """
    paths: dict[str, list[str]] = {}
    for row in folder_files(spark, folder).select("table", "path").collect():
        paths.setdefault(row["table"], []).append(row["path"])
    out = None
    for table, files in sorted(paths.items()):
        part = _raw(spark, files, sep).withColumn("table", F.lit(table))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_json_field(df: DataFrame, col: str, path: str, default, out: str, kind: str = "string") -> DataFrame:
    """One field of a JSON text column, with a default for absent or bad values."""
    value = F.get_json_object(F.col(col), path).try_cast(kind)
    return df.withColumn(out, F.coalesce(value, F.lit(default)))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records with a given schema."""
    return spark.read.schema(schema).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, props: Mapping[str, str] | None = None,
              partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Table of a database; ``partition`` = (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **dict(props or {}))
    if partition is not None:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small typed-in table, such as a dictionary or published results."""
    return spark.createDataFrame(list(rows), schema)


def find_tables_with_column(tables: Mapping[str, DataFrame], col: str) -> DataFrame:
    """Tables that have the column, with its non-null count (one aggregate per such table)."""
    out = None
    for name, df in tables.items():
        if col in df.columns:
            one = df.agg(F.count(col).alias("non_null")).select(F.lit(name).alias("table"), "non_null")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no table has the column {col!r}")
    return out


def find_tables(spark: SparkSession, folder: str, keywords: Sequence[str]) -> DataFrame:
    """Files below a folder whose name contains any keyword, case ignored."""
    files = folder_files(spark, folder)
    hit: Column = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(F.lower("file"), F.lit(word.lower()))
    return files.where(hit).select("file", "bytes")
