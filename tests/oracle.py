"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str = DATA):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    return f"{float(v):.6g}" if isinstance(v, float | np.floating) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))
