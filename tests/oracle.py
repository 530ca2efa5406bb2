"""Compare a Spark result with DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    out = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        out.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return out


def plain(frame):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(cell, row)) for row in frame.astype(object).itertuples(index=False, name=None)), key=str)


def same(spark_frame, sql, connection):
    want, got = connection.sql(sql).df(), spark_frame.toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    assert plain(got[columns]) == plain(want[columns])
