"""Compare a Spark result with DuckDB's on the same tables."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.8g}") + 0.0
    if isinstance(x, (int, np.integer)):
        return float(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(norm(i) for i in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), norm(v)) for k, v in x.items()))
    if isinstance(x, (datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(x).tz_localize(None) if pd.Timestamp(x).tzinfo is None else pd.Timestamp(x).tz_convert("UTC").tz_localize(None)
    return x


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols, got = rows(df.toPandas())
    cols2, want = rows(con.execute(sql).df())
    assert cols == cols2
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w, (cols, g, w)
