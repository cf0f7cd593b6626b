"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(rows, key=repr)


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, text):
    cursor = con.execute(text)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def difference(df, con, text) -> str | None:
    """What differs between the two results; None when nothing does."""
    columns, rows = spark_result(df)
    want_columns, want = duck_result(con, text)
    if columns != want_columns:
        return f"columns {columns} against {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}"
    wrong = [(a, b) for a, b in zip(rows, want) if repr(a) != repr(b)]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0]}"
    return None
