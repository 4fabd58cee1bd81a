"""Runs a query and its SQL side by side over the smallest tables."""

import glob
import math
import os

import duckdb

TABLES = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def assert_same(spark, query, sql):
    df = query(spark, TABLES)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = con.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted("|".join(plain(x[c]) for c in columns) for x in df.collect()) == sorted("|".join(plain(x[i]) for i in at) for x in r.fetchall())
