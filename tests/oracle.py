"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
