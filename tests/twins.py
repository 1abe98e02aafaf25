"""Comparison of a query with its SQL twin, as multisets of rows with floats to nine figures."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, con, query, sql) -> None:
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())
    assert got == want, f"only Spark: {list(got - want)[:3]}; only SQL: {list(want - got)[:3]}"
