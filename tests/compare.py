"""Rows of a Spark query against rows of its SQL in DuckDB, in any order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return f"{float(value):.6g}"
    return value


def assert_same(df, sql: str, con: duckdb.DuckDBPyConnection) -> int:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    want = sorted(repr([canonical(r[names.index(c)]) for c in order]) for r in cur.fetchall())
    got = sorted(repr([canonical(r[c]) for c in order]) for r in df.collect())
    assert len(want) == len(got), (len(want), len(got))
    diff = [(a, b) for a, b in zip(want, got, strict=True) if a != b]
    assert not diff, diff[:3]
    return len(got)
