"""Run a registered query and its SQL side by side and compare rows without regard to order."""

from __future__ import annotations

import glob
import hashlib
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def digest(columns: list[str], rows) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_plain(r[i]) for i in order) for r in rows)
    return sorted(columns), len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest()


def rows_of_spark(df):
    return df.columns, [tuple(r) for r in df.collect()]


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()
