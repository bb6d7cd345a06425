"""Comparing a query with its SQL on the same tables."""

import math
import os

import duckdb


def connect(root):
    con = duckdb.connect()
    for f in sorted(os.listdir(root)):
        path = f"{root}/{f}" if os.path.isfile(f"{root}/{f}") else f"{root}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def text(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
