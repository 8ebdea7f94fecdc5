"""Side-by-side comparison of a Spark result and its SQL twin (names, types, rows)."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t) -> str:
    text = str(t)
    return text.replace("large_string", "string").replace("large_list", "list").replace("list<item: ", "list<").replace(
        "list<element: ", "list<").replace("list<l: ", "list<").replace("string_view", "string")


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    return repr(v)


def _rows(tbl, names):
    cols = [tbl.column(n).to_pylist() for n in names]
    return sorted((tuple(_cell(v) for v in row) for row in zip(*cols)), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both results agree exactly, else what differs."""
    ours, theirs = df.toArrow(), con.execute(sql).to_arrow_table()
    a, b = sorted(ours.column_names), sorted(theirs.column_names)
    if a != b:
        return f"columns {a} != {b}"
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} != {theirs.num_rows}"
    types = [(n, _kind(ours.schema.field(n).type), _kind(theirs.schema.field(n).type)) for n in a]
    wrong = [t for t in types if t[1] != t[2]]
    if wrong:
        return f"types {wrong}"
    left, right = _rows(ours, a), _rows(theirs, a)
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    return f"{len(bad)} of {len(left)} rows differ {a}: {bad[:3]}" if bad else None
