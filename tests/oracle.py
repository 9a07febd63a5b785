"""Compare a query's rows with its SQL run by DuckDB on the same tables."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    return repr(0.0 if isinstance(v, float) and v == 0 else v)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, sql, sf_dir):
    got, want = df.toPandas(), connect(sf_dir).sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got = got.astype({c: "Int64" for c in cols if str(want[c].dtype) == "Int64"})  # whole numbers with nulls
    rows = [sorted(tuple(map(norm, r)) for r in x[cols].astype(object).itertuples(index=False, name=None)) for x in (got, want)]
    assert rows[0] == rows[1]
