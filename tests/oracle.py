"""Runs SQL in DuckDB over the same tables and compares rows."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def same_rows(df, con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    order = [columns.index(c) for c in names]
    a = sorted(str(tuple(row[c] for c in names)) for row in df.collect())
    b = sorted(str(tuple(row[i] for i in order)) for row in want)
    assert a == b
    return len(a)
