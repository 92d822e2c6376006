"""Comparison of Spark queries with their SQL."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], data) -> tuple[list[str], list[str]]:
    order = sorted(columns)
    return order, sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in data)


def same_as_sql(spark, run, sql: str, folder: str = DATA) -> None:
    df = run(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connect(folder).execute(sql)
    theirs = rows([d[0] for d in result.description], result.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
