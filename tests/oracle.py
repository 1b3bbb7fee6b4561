"""Runs a query and its oracle SQL on the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, con, query, sql: str) -> None:
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in out.fetchall()), key=str)
    assert columns == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [type(x) for x in a] == [type(y) for y in b]
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)
