"""Compare a query with its SQL on the same tables."""

import math
import os

import duckdb


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None else repr(float(v)) if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(str([clean(r[i]) for i in order]) for r in values)


def same(spark, name, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = views(folder).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), name
    assert got == want, (name, got[:2], want[:2])
