"""Comparison of a Spark result with DuckDB's over the same parquet tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

_LONG = 1 << 40


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return round(float(x), 6) if abs(x) < _LONG else x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return plain(float(x))


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def duck(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, data = duck(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    want, got = rows(columns, data), rows(df.columns, df.collect())
    assert got == want, f"{sum(want.values())} rows wanted, {sum(got.values())} got; missing {list((want - got).items())[:3]}, too many {list((got - want).items())[:3]}"
