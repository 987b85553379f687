"""Compares a query's rows with its SQL in DuckDB, columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), sorted_rows(columns, found.fetchall())


def assert_same(df, sf: str, sql: str) -> None:
    columns, rows = duck_rows(sf, sql)
    assert sorted(df.columns) == columns
    assert sorted_rows(df.columns, df.collect()) == rows
