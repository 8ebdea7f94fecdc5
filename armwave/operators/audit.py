"""Column audits. One aggregation pass profiles all columns; pruning is then a plain select."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.operators.columns import cast_by_dictionary, code_texts, null_codes

CELLS = 1 << 20  # cells and values that a task of pair_cells holds


def profile(df: DataFrame, dictionary: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """Non-null count, null share, distinct count and description of every column.

    Exact distinct counts come from (column, value) counts, which combine on the map side.
    """
    cols = df.columns
    if approx:
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in cols],
                      *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d_{c}") for c in cols])
        entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`n_{c}`").alias("non_null"),
                                               F.col(f"`d_{c}`").alias("distinct")) for c in cols]))
        stats = wide.select("_rows", entries.alias("e")).select("_rows", "e.*")
    else:
        entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
        values = df.select(entries.alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))
        stats = values.groupBy("column").agg(
            F.sum("n").alias("_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.count("value").alias("distinct"),
        )
    out = stats.select(
        "column", "non_null", (F.lit(100.0) * (F.col("_rows") - F.col("non_null")) / F.col("_rows")).alias("null_pct"), "distinct")
    if dictionary is not None:
        out = out.join(dictionary.select("column", "description").dropDuplicates(["column"]), "column", "left")
    return out


def _quick_stats(df: DataFrame) -> tuple[int, dict[str, tuple[int, bool]]]:
    """Rows, and per column (non-null count, more than one value), from one pass without shuffle of values."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}"),
                 (F.min(F.col(f"`{c}`")) < F.max(F.col(f"`{c}`"))).alias(f"v{i}")]
    row = df.agg(*aggs).first()
    return row["_rows"], {c: (row[f"n{i}"], bool(row[f"v{i}"])) for i, c in enumerate(df.columns)}


def non_null_cols(df: DataFrame) -> DataFrame:
    """Columns with more than one non-null value."""
    _, stats = _quick_stats(df)
    return df.select(*[c for c in df.columns if stats[c][0] > 1])


def drop_empty(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    _, stats = _quick_stats(df)
    return df.select(*[c for c in df.columns if stats[c][0] > 0 or c in keep])


def drop_constant(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    _, stats = _quick_stats(df)
    return df.select(*[c for c in df.columns if stats[c][1] or c in keep])


def drop_sparse(df: DataFrame, pct: float, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose null share is strictly above ``pct`` percent."""
    rows, stats = _quick_stats(df)
    return df.select(*[c for c in df.columns if c in keep or (rows - stats[c][0]) * 100.0 <= pct * rows])


def raw_twins(names: Sequence[str]) -> list[tuple[str, str]]:
    """(dropped, kept) name pairs: a mean score with a total twin, a raw score with a base twin."""
    totals = {n[:-2]: n for n in names if n.endswith("t")}
    present = set(names)
    pairs = [(n, totals[n[:-2]]) for n in names if n.endswith("x") and n[:-2] in totals]
    return pairs + [(n, n[:-4]) for n in names if n.endswith("raw") and n[:-4] in present]


def drop_raw_twins(df: DataFrame, add: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    gone = ({pair[0] for pair in raw_twins(df.columns)} | set(add)) - set(keep)
    return df.select(*[c for c in df.columns if c not in gone])


def pruned_columns(df: DataFrame, add: Sequence[str] = (), keep: Sequence[str] = (), pct: float = 50) -> list[str]:
    """Names left after the empty, constant, raw-twin and sparse rules, from one pass."""
    rows, stats = _quick_stats(df)
    left = [c for c in df.columns if c in keep or (stats[c][0] > 0 and stats[c][1])]
    gone = ({pair[0] for pair in raw_twins(left)} | set(add)) - set(keep)
    left = [c for c in left if c not in gone]
    return [c for c in left if c in keep or (rows - stats[c][0]) * 100.0 <= pct * rows]


def prune(df: DataFrame, add: Sequence[str] = (), keep: Sequence[str] = (), pct: float = 50) -> DataFrame:
    return df.select(*pruned_columns(df, add, keep, pct))


def verify_audit(df: DataFrame, codes: Sequence) -> DataFrame:
    """Which codes are still present: (code, columns that hold it)."""
    texts = code_texts(codes)
    flags = df.agg(*[F.max(F.coalesce(F.col(f"`{c}`").cast("string") == t, F.lit(False))).alias(f"{i}|{j}")
                     for i, t in enumerate(texts) for j, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(t).alias("code"), F.lit(c).alias("column"), F.col(f"`{i}|{j}`").alias("present"))
               for i, t in enumerate(texts) for j, c in enumerate(df.columns)]
    return flags.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("present").drop("present")


def name_report(names: Sequence[str]) -> dict[str, object]:
    """Column names by ending, and whether the table is too narrow to be of use."""
    return {
        "x": [n for n in names if n.endswith("x")],
        "t": [n for n in names if n.endswith("t")],
        "raw": [n for n in names if n.endswith("raw")],
        "unusable": len(names) <= 3,
    }


def pre_audit(df: DataFrame, dictionary: Mapping[str, str], type_names: Mapping[str, str], codes: Sequence,
              add: Sequence[str] = (), keep: Sequence[str] = (), pct: float = 20,
              skip: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Missing codes to null, the check that none is left, casts by dictionary, then pruning.

    Columns of ``skip`` may keep their codes; a code left in another column is an error.
    """
    nulled = null_codes(df, codes, skip)
    checked = nulled.drop(*(skip or {}))
    left = verify_audit(checked, codes).take(10) if checked.columns and codes else []
    if left:
        raise ValueError(f"missing codes left: {[(r['code'], r['column']) for r in left]}")
    return prune(cast_by_dictionary(nulled, dictionary, type_names, keep), add, keep, pct)


def search_dictionary(dictionary: DataFrame, words: Sequence[str], text: str = "description") -> DataFrame:
    """Dictionary rows whose text matches any word, case ignored."""
    return dictionary.where(F.col(text).rlike("(?i)" + "|".join(words)))


def pair_cells(df: DataFrame, cols: Sequence[str], held: int = CELLS) -> DataFrame:
    """(left, right, a, b, n): partial counts of value pairs of every two columns, nulls left out; a pair may come once per task.

    Values of a batch are coded, cells of a column pair counted as numbers, and cells of a task summed up before they leave it. A task that
    holds more than ``held`` cells after summing (columns that are nearly keys) hands them on and starts anew.
    """
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict] = [{} for _ in cols]
        parts: list[np.ndarray] = []

        def summed() -> np.ndarray:
            x = np.concatenate(parts, axis=1)
            x = x[:, np.lexsort(x[2::-1])]
            head = np.flatnonzero(np.append(True, (x[:3, 1:] != x[:3, :-1]).any(axis=0)))
            return np.vstack([x[:3, head], np.add.reduceat(x[3], head)])

        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            values = [np.array([*k, None], object) for k in known]
            for first in range(0, x.shape[1], 1 << 16):
                pair, a, b, n = x[:, first: first + (1 << 16)]
                left, right = np.divmod(pair, len(cols))
                texts = [pa.array([values[c][v] for c, v in zip(side.tolist(), codes.tolist())], pa.string()) for side, codes in ((left, a), (right, b))]
                names = [pa.array(cols, pa.string()).take(pa.array(side)) for side in (left, right)]
                yield pa.RecordBatch.from_arrays([*names, *texts, pa.array(n)], names=["left", "right", "a", "b", "n"])

        for batch in batches:
            coded = []
            for own, column in zip(known, batch.columns):
                d = column.dictionary_encode()
                to = np.array([own.setdefault(v, len(own)) for v in d.dictionary.to_pylist()] + [-1])
                coded.append(to[d.indices.fill_null(len(to) - 1).to_numpy(zero_copy_only=False)])
            for i, a in enumerate(coded):
                for j in range(i + 1, len(coded)):
                    both = (a >= 0) & (coded[j] >= 0)
                    width = len(known[j])
                    cell = a[both] * width + coded[j][both]
                    if len(known[i]) * width <= 4 * batch.num_rows:
                        n = np.bincount(cell)
                        cell = np.flatnonzero(n)
                        n = n[cell]
                    else:
                        cell, n = np.unique(cell, return_counts=True)
                    if len(cell):
                        parts.append(np.vstack([np.full(len(cell), i * len(cols) + j), cell // width, cell % width, n]))
            values = sum(map(len, known))
            if sum(p.shape[1] for p in parts) + values > 2 * held:
                parts = [summed()] if parts else []
                if values + sum(p.shape[1] for p in parts) > held:
                    for p in parts:
                        yield from out(p)
                    parts, known = [], [{} for _ in cols]
        if parts:
            yield from out(summed())

    texts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    return texts.mapInArrow(run, "left string, right string, a string, b string, n long")


def top_assoc(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Column pairs with the highest Cramer's V.

    Value pairs are counted first, per task, so all that is shuffled depends on distinct values, not on rows.
    """
    cells = pair_cells(df, cols).groupBy("left", "right", "a", "b").agg(F.sum("n").cast("double").alias("n"))
    rows = cells.groupBy("left", "right", "a").agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy("left", "right", "b").agg(F.sum("n").alias("col_n"))
    sizes = rows.groupBy("left", "right").agg(F.sum("row_n").alias("total"), F.count("a").alias("n_a"))
    widths = columns.groupBy("left", "right").agg(F.count("b").alias("n_b"))
    # chi-square = total * (sum n^2 / (row * column) - 1): cells with no rows add nothing
    ratio = (
        cells.join(rows, ["left", "right", "a"]).join(columns, ["left", "right", "b"])
        .groupBy("left", "right").agg(F.sum(F.col("n") * F.col("n") / (F.col("row_n") * F.col("col_n"))).alias("ratio"))
    )
    v = F.sqrt(F.greatest(F.try_divide(F.col("ratio") - 1, F.least("n_a", "n_b") - F.lit(1)), F.lit(0.0)))
    return (
        ratio.join(sizes, ["left", "right"]).join(widths, ["left", "right"])
        .select("left", "right", v.alias("cramer_v"))
        .orderBy(F.col("cramer_v").desc_nulls_last(), "left", "right").limit(k)
    )


def overlap(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Sizes of the pairwise and the overall key overlap, from one aggregation by key."""
    tagged = reduce(lambda a, b: a.unionByName(b), [
        df.select(key).where(F.col(key).isNotNull()).select(key, F.lit(name).alias("_set")) for name, df in sets.items()])
    names = list(sets)
    member = tagged.groupBy(key).agg(*[F.max(F.col("_set") == n).alias(n) for n in names])
    pairs = {f"{a} & {b}": F.col(a) & F.col(b) for i, a in enumerate(names) for b in names[i + 1:]}
    pairs["all"] = reduce(lambda x, y: x & y, [F.col(n) for n in names])
    counts = member.agg(*[F.count_if(test).alias(label) for label, test in pairs.items()])
    return counts.unpivot([], [f"`{p}`" for p in pairs], "pair", "n")


def dup_columns(df: DataFrame) -> list[str]:
    seen: set[str] = set()
    return [c for c in df.columns if c in seen or seen.add(c)]


def check_types(names: DataFrame, types: DataFrame, name: str = "name") -> DataFrame:
    """Features that no type row covers."""
    return names.join(types, name, "left_anti")


# Rater suffixes of wide column names.
RATER_SUFFIXES = ("m", "f", "c", "t")


def rater_counts(names: DataFrame, name: str = "name") -> DataFrame:
    """Feature count per rater suffix (``_m``, ``_f``, ``_c``, ``_t``)."""
    rater = F.regexp_extract(F.col(name), "_([" + "".join(RATER_SUFFIXES) + "])$", 1)
    return names.select(rater.alias("rater")).where(F.col("rater") != "").groupBy("rater").agg(F.count(F.lit(1)).alias("n"))


def rater_combo(m: str = "m", f: str = "f", t: str = "t"):
    """Which raters feed a run, from their feature counts: m, f, t, all, or ambiguous.

    Mother with teacher counts as all; a run with the child only is filed under f.
    """
    has = {r: F.coalesce(F.col(c), F.lit(0)) > 0 for r, c in (("m", m), ("f", f), ("t", t))}
    adults = sum((F.when(h, 1).otherwise(0) for h in has.values()), F.lit(0))
    single = F.when(has["m"], "m").when(has["t"], "t").otherwise("f")
    return F.when(has["m"] & has["t"], "all").when(adults <= 1, single).otherwise("ambiguous")
