"""Rows of a query and of its SQL, in a form that can be compared."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or v != v:
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def both(spark, con, query, sql):
    got = query(spark, FOLDER)
    want = con.execute(sql)
    return plain(got.columns, got.collect()), plain([c[0] for c in want.description], want.fetchall())
