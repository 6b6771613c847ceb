"""Compares a registered query with its SQL on the same tables."""

import datetime
import decimal
import glob
import math
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return [plain(x) for x in v]


def as_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        ([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r]
    )


def differences(df, con, sql):
    """None if equal, else a short description."""
    got_columns, got = as_set(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns, want = as_set([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"[:1500]
    return None
