"""Comparison of a query with its SQL, order aside."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(sf: str = DATA):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(sf + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def same(df, sql, c) -> None:
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[x]) for x in cols) for r in df.collect())
    rel = c.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
