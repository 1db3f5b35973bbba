"""Compares a Spark result with DuckDB's answer to SQL over the same tables, without regard to order."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c.execute(sql).fetchdf()
