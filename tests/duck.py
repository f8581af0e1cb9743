"""Rows of a DuckDB query over a folder of parquet tables, and rows in a form that can be compared."""

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = c.sql(sql)
    names = got.columns
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, got.fetchall())
