"""Compare a query with its SQL, as sets of rows with columns by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def text(v):
    return ("nan" if math.isnan(v) else repr(v)) if isinstance(v, float) else str(v)


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
    return len(got)
