"""Compares a query with its SQL in DuckDB, whatever the order of rows and columns."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(repr(canon(r[i])) for i in order) for r in rows)


def expected(sql, where=DATA):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{where}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    r = c.sql(sql)
    return table(r.columns, r.fetchall())


def actual(df):
    return table(df.columns, [tuple(r) for r in df.collect()])
