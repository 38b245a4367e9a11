"""Runs a query beside its oracle SQL and compares columns, types and values, in any order."""

from __future__ import annotations

import os

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows_of(pdf):
    cells = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in cells.itertuples(index=False))


def compare(df, con, sql: str) -> None:
    relation = con.sql(sql)
    expected = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == expected
    assert rows_of(df.toPandas()) == rows_of(relation.df())
