"""Compare a Spark result with DuckDB's, rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame, columns):
    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, float) and math.isnan(x):
            return None
        return x

    return sorted((tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


def same(spark_df, sql: str, folder: str = DATA) -> None:
    got, want = spark_df.toPandas(), connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
