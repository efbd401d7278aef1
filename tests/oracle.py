"""Runs a query's SQL in DuckDB on the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else x + 0.0
        return x

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


def same(df, sql, sf_dir):
    rel = connect(sf_dir).sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = plain((dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()), names)
    got = plain((r.asDict() for r in df.collect()), names)
    assert len(got) == len(want)
    assert got == want
