"""Run registered queries against their oracle SQL on one data folder."""

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
            path = f"{path}/*.parquet" if glob.glob(f"{path}/*.parquet") else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_cell, x)) + "]"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    got, expected = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    assert len(got) == len(expected), (len(got), len(expected))
    different = [(g, w) for g, w in zip(got, expected) if g != w]
    assert not different, (len(different), different[:3])
