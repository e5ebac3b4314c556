"""Compare a DataFrame with rows from DuckDB, by value and without order."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.datetime)):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 1 << 50 else str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return str(x)


def rows(names: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())
