"""Run a query beside its SQL."""

import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
            return "NULL"
        return str(v)

    return list(df.columns), sorted(tuple(map(value, r)) for r in df.itertuples(index=False, name=None))
