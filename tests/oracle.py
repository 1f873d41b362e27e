"""Compares a query with its SQL, rows as a multiset, floats to nine digits."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def key(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    return tuple(map(key, v)) if isinstance(v, (list, tuple)) else v


def differ(df, sql: str, sf: str) -> tuple[list, list]:
    names = sorted(df.columns)
    got = Counter(tuple(key(r[n]) for n in names) for r in df.collect())
    q = connect(sf).execute(sql)
    has = [d[0] for d in q.description]
    assert sorted(has) == names, (sorted(has), names)
    want = Counter(tuple(key(r[has.index(n)]) for n in names) for r in q.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3]
