"""Column selection, renames, casts and missing codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_cols(
    df: DataFrame,
    startswith: str | None = None,
    endswith: str | None = None,
    contains: str | None = None,
    positions: slice | None = None,
    always: Sequence[str] = (),
) -> DataFrame:
    """Columns whose name passes every given rule, after the ``always`` columns."""
    names = df.columns[positions] if positions is not None else df.columns
    kept = [
        c
        for c in names
        if (startswith is None or c.startswith(startswith))
        and (endswith is None or c.endswith(endswith))
        and (contains is None or contains in c)
    ]
    return df.select(*always, *[c for c in kept if c not in always])


def rename_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


def lower_cols(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def move_column(df: DataFrame, name: str, position: int) -> DataFrame:
    """Put one column at a position; the others keep their order."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest[:position], name, *rest[position:])


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def drop_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def cast_by_map(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Lenient casts by column name; names the table lacks are ignored."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


# Identity, demographic and time columns carried by every questionnaire.
BASE_TYPES = {
    "src_subject_id": "string",
    "sex": "string",
    "site": "string",
    "interview_age": "int",
    "days_baseline": "int",
    "trtname": "string",
}


def cast_base(df: DataFrame, types: Mapping[str, str] = BASE_TYPES, date_col: str = "interview_date",
              date_format: str = "MM/dd/yyyy") -> DataFrame:
    """Base types of a questionnaire; the date is parsed from text, bad text gives null."""
    out = cast_by_map(df, types)
    if date_col in df.columns and dict(df.dtypes)[date_col] == "string":
        out = out.withColumn(date_col, F.try_to_date(F.col(date_col), date_format))
    return out


def cast_by_dictionary(
    df: DataFrame, dictionary: Mapping[str, str], type_names: Mapping[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """Cast by data dictionary (name -> declared type) and drop columns it does not list."""
    kept = [c for c in df.columns if c in dictionary or c in keep]
    casts = {c: type_names[dictionary[c]] for c in kept if dictionary.get(c) in type_names}
    return cast_by_map(df.select(*kept), casts)


def dictionary_map(dictionary: DataFrame, columns: Sequence[str], name: str = "ElementName", kind: str = "DataType") -> dict:
    """Declared types of the table's own columns. At most one row per column reaches the driver."""
    mine = dictionary.where(F.col(name).isin(list(columns))).groupBy(name).agg(F.min(kind).alias("kind"))
    return {r[0]: r[1] for r in mine.collect()}


def to_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lenient numeric cast; bad text and NaN give null."""
    return df.withColumns({c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in cols})


def code_texts(codes: Sequence) -> list[str]:
    """Missing codes as numbers and as their text twins, as one list of texts."""
    texts = []
    for code in codes:
        for text in (str(code), str(float(code)) if not isinstance(code, str) else str(code)):
            if text not in texts:
                texts.append(text)
    return texts


def null_codes(df: DataFrame, codes: Sequence, skip: Mapping[str, Sequence] | None = None,
               cols: Sequence[str] | None = None) -> DataFrame:
    """Missing codes to null in every column. ``skip`` lists codes that stay valid for a column."""
    skip = skip or {}
    changed = {}
    for c in cols or df.columns:
        kept = set(code_texts(skip.get(c, ())))
        texts = [t for t in code_texts(codes) if t not in kept]
        changed[c] = F.when(~F.coalesce(F.col(c).cast("string").isin(texts), F.lit(False)), F.col(c))
    return df.withColumns(changed)


def fill_const(df: DataFrame, value, cols: Sequence[str]) -> DataFrame:
    return df.fillna(value, subset=list(cols))
