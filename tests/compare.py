"""Holding a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0 if math.isfinite(x) else str(x)
    return x


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=str)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = database(sf_dir).execute(sql)
    names = [x[0] for x in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {df.columns} and {names}"
    if got != want:
        a, b = set(map(str, got)) - set(map(str, want)), set(map(str, want)) - set(map(str, got))
        return f"{name}: {len(got)} and {len(want)} rows; only in Spark: {sorted(a)[:4]}; only in SQL: {sorted(b)[:4]}"
    return ""
