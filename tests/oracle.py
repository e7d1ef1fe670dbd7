"""Compares registered queries with their SQL in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def assert_same(con, df, sql):
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(value(r[i]) for i in at) for r in cur.fetchall())
    got = sorted(tuple(value(x) for x in r) for r in df.select(*[df[c] for c in cols]).collect())
    assert got == want
