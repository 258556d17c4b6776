"""Runs a query on Spark and its twin on DuckDB and compares names and rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    answer = con.sql(sql)
    if sorted(df.columns) != sorted(answer.columns):
        return f"columns {sorted(df.columns)} and {sorted(answer.columns)}"
    got, want = rows(df.columns, df.collect()), rows(answer.columns, answer.fetchall())
    if got != want:
        odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
        return f"{len(got)} and {len(want)} rows, first differing {odd}"
    return ""
