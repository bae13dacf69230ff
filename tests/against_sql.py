"""Runs a registered query and its SQL on the smallest test tables and compares the rows."""

import os

DATA = "/root/testdata/sf0.001"
HAVE = os.path.isdir(DATA)


def connection():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def same(spark, con, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr) == want
