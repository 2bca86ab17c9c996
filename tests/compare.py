"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import os

import duckdb


def _value(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def check(spark, sf_dir: str, query, sql: str, con) -> None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert got == rows_of(r.columns, r.fetchall())
