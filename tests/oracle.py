"""Compares a query with its SQL in DuckDB on the same tables, whatever the order of rows and columns."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else x + 0.0
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {t} AS FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.sql(sql)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(found.columns), (df.columns, found.columns)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect())
    at = [found.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    assert got == want, (len(got), len(want), list((got - want).items())[:3], list((want - got).items())[:3])
    assert got, "no rows"
