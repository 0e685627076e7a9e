"""Holds a query's rows against its SQL in DuckDB: names, counts and values, without regard to order."""

import datetime

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(v))
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def values(frame):
    return sorted(tuple(str(plain(v)) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def compare(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)
