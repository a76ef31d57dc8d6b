"""Rows of a Spark query and of its DuckDB SQL in one comparable form."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{path}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(p + '/*.parquet') if os.path.isdir(p) else [p]})")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


def rows_of(records, cols) -> list[tuple]:
    return sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in records), key=lambda r: tuple(map(str, r)))


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of((r.asDict() for r in df.collect()), df.columns)


def of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    return sorted(cols), rows_of((dict(zip(cols, r, strict=True)) for r in got.fetchall()), cols)
