"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "asDict"):
        return repr(sorted((k, normal(x)) for k, x in v.asDict().items()))
    if isinstance(v, list | tuple):
        return repr([normal(x) for x in v])
    if isinstance(v, dict):
        return repr(sorted((k, normal(x)) for k, x in v.items()))
    return repr(v)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f if f.is_file() else f / '*.parquet'}')")
    return con


def compare(con, df, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(normal(x[i]) for i in at) for x in r.fetchall())
