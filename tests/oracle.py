"""Spark-vs-DuckDB comparison used by the tests (same rules as the driver's check:
row count, column names, order-insensitive values)."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        if os.path.exists(f):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame()
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.dt.strftime("%Y-%m-%d %H:%M:%S").str.replace(" 00:00:00", "", regex=False)
        elif s.dtype == object:
            s = s.map(lambda v: None if v is None else (str(v).replace(" 00:00:00", "")
                                                      if not isinstance(v, (list, dict)) else str(v)))
        elif pd.api.types.is_bool_dtype(s):
            s = s.astype("object")
        elif pd.api.types.is_numeric_dtype(s):
            s = s.astype("float64")
        out[c] = s
    return out


def compare(spark_df, sql: str, con) -> dict:
    a = _norm(spark_df.toPandas())
    b = _norm(con.sql(sql).df())
    res = {"rows": (len(a), len(b)), "cols_match": list(a.columns) == list(b.columns)}
    if not res["cols_match"]:
        res["cols"] = (list(a.columns), list(b.columns))
        res["ok"] = False
        return res
    keys = list(a.columns)
    a = a.sort_values(keys, na_position="first", kind="mergesort").reset_index(drop=True)
    b = b.sort_values(keys, na_position="first", kind="mergesort").reset_index(drop=True)
    bad = {}
    if len(a) == len(b):
        for c in keys:
            x, y = a[c], b[c]
            eq = (x == y) | (x.isna() & y.isna())
            if x.dtype == "float64" and y.dtype == "float64":
                import numpy as np
                eq = eq & (np.signbit(x.fillna(0).to_numpy()) == np.signbit(y.fillna(0).to_numpy()))
            if not eq.all():
                bad[c] = int((~eq).sum())
    res["bad_cols"] = bad
    res["ok"] = len(a) == len(b) and not bad
    return res
