"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TESTDATA = os.environ.get("SPANWEAVE_TESTDATA", "/root/testdata")


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), _rows(columns, found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _rows(df.columns, df.collect())


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """Empty if both have the same columns and rows."""
    columns, rows = spark_rows(df)
    want_columns, want = duck_rows(sql, sf_dir)
    if columns != want_columns:
        return [f"columns {columns} but SQL has {want_columns}"]
    if rows == want:
        return []
    mine, theirs = [r for r in rows if r not in set(want)], [r for r in want if r not in set(rows)]
    return [f"{len(rows)} rows, SQL has {len(want)}", f"only Spark: {mine[:3]}", f"only SQL: {theirs[:3]}"]
