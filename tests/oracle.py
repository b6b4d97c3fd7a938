"""Queries against their SQL on one data folder."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def canon(df):
    df = df[sorted(df.columns)]

    def show(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "nan"):
            return "NULL"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


def same(spark, sf, queries, sql, name):
    got = queries[name](spark, sf).toPandas()
    want = connect(sf).sql(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
