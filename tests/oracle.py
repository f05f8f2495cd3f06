"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def comparable(table, columns):
    return sorted((tuple(_value(r[c]) for c in columns) for r in table.to_pylist()), key=repr)


def check(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    columns = sorted(df.columns)
    want = con.sql(sql).to_arrow_table()
    assert sorted(want.column_names) == columns, name
    got = df.toArrow()
    assert comparable(got, columns) == comparable(want, columns), name
    return got.num_rows
