"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    rows = rel.select(*[f'"{n}"' for n in names]).fetchall() if names else []
    return names, Counter(tuple(map(_plain, r)) for r in rows)


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(map(_plain, r)) for r in df.select(*names).collect())
