"""Runs a query and its DuckDB SQL over one folder and compares all rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "~"
        return repr(float(v)) if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(show(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def whole(df, other):  # a nullable integer column comes as float on one side
        for c in df.columns:
            if df[c].dtype.kind == "f" and other[c].dtype.kind in "iu" or str(other[c].dtype).startswith("Int"):
                df[c] = df[c].astype("Int64")
        return df

    assert rows(whole(got, want)) == rows(whole(want, got))
