"""Runs a query and its SQL and compares the rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            at = f"{sf_dir}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{at}/*.parquet'" if os.path.isdir(at) else f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{at}'")
    found = con.sql(sql)
    return found.columns, [tuple(plain(x) for x in r) for r in found.fetchall()]


def same(df, sql: str, sf_dir: str) -> int:
    """Number of rows, which are the same."""
    columns, expected = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in expected), key=repr)
    assert got == want
    return len(got)
