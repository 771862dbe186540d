"""Run queries on Spark and DuckDB and compare them, column by column."""

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, f"{v:.6f}" if v else "0.000000")
    return (3, str(v))


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    got = fn(spark, sf_dir)
    cols = sorted(got.columns)
    mine = sorted(tuple(_cell(r[c]) for c in cols) for r in got.collect())
    t1 = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (name, sorted(names), cols)
    order = [names.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    t2 = time.time()
    diff = None
    if mine != want:
        a, b = set(mine), set(want)
        diff = (len(mine), len(want), sorted(a - b)[:3], sorted(b - a)[:3])
    return len(mine), t1 - t0, t2 - t1, diff
