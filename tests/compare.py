"""A query's rows against DuckDB's for the SQL beside it."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def tables(con: duckdb.DuckDBPyConnection, d: str) -> None:
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, sql: str, d: str = DATA) -> None:
    con = duckdb.connect()
    tables(con, d)
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
