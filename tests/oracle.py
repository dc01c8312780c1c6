"""Compare queries with DuckDB over the same tables, as the driver does: by column name, in any row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if glob.os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def compare(df, sql: str, sf_dir: str) -> None:
    got = df.toPandas()
    want = connect(sf_dir).execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(order).collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (a, b)
