"""Holds a query's rows against its DuckDB oracle's."""

from __future__ import annotations

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def tables(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(found, columns: list[str]) -> list[tuple]:
    return sorted((tuple(plain(x) for x in r) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


def assert_same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(frame.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(frame.select(*columns).collect(), columns) == rows(want.select(quoted).fetchall(), columns)
