"""Compares a Spark result with DuckDB SQL over the same tables."""

import math
import os

import duckdb

from lodestone.tables import TABLES


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.sql(sql)
    return list(found.columns), found.fetchall()


def assert_same(df, sql: str, folder: str) -> int:
    names, want = rows_of(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(map(tidy, r)) for r in df.collect()), key=key)
    want = sorted((tuple(tidy(r[k]) for k in order) for r in want), key=key)
    assert got == want
    return len(got)
