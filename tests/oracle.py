"""Comparison of registered queries with their SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = "/root/testdata/sf0.001"


def connect(folder: str = TESTDATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of_both(spark, con, run, sql: str, folder: str = TESTDATA):
    df = run(spark, folder)
    names = sorted(df.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{n}`" for n in names]).collect())
    cols = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(repr(tuple(map(plain, r))) for r in con.execute(f"SELECT {cols} FROM ({sql})").fetchall())
    return ours, theirs
