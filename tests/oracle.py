"""Compares a Spark result with DuckDB on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(cols, data):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}"
        return str(v)

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, sql, sf_dir):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())
