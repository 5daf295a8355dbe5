"""Compare a DataFrame with DuckDB's result of a query over the same Parquet tables."""

import os

import duckdb
import pandas as pd


def _text(v):
    if v is None or v is pd.NaT or v != v:
        return "NULL"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted(map(tuple, df[sorted(df.columns)].map(_text).to_numpy().tolist()))


def duck(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con.sql(sql).df()


def assert_same(df, sql: str, folder: str) -> None:
    got, want = df.toPandas(), duck(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
