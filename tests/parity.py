"""Compare a query with its SQL in DuckDB over the same files."""

import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    if hasattr(v, "hour"):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
