"""Runs a query and its SQL over the smallest tables and compares rows, order aside."""

import os

import duckdb

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same_rows(spark, con, query, sql):
    a, rel = query(spark, DIR), con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(a.columns) == sorted(names)
    order = sorted(names)
    left = sorted(tuple(plain(r[c]) for c in order) for r in a.collect())
    right = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
    assert left == right
