"""Compares a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, date) and not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    listed = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(listed, key=lambda row: tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row))


def kind(name: str) -> str:
    low = name.lower()
    for word, group in (("bigint", "int64"), ("int", "int32"), ("double", "double"), ("decimal", "decimal"), ("timestamp", "timestamp"), ("date", "date"), ("varchar", "string"), ("string", "string"), ("bool", "bool")):
        if word in low:
            return group
    return low


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    wanted_names = [d[0] for d in found.description]
    wanted_kinds = {d[0]: kind(str(d[1])) for d in found.description}
    wanted = as_rows(wanted_names, found.fetchall())
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if got[0] != wanted[0]:
        return [f"columns {got[0]} instead of {wanted[0]}"]
    kinds = {n: kind(t) for n, t in df.dtypes}
    if kinds != wanted_kinds:
        problems.append(f"types {dict(sorted((n, (kinds[n], wanted_kinds[n])) for n in kinds if kinds[n] != wanted_kinds[n]))}")
    if len(got[1]) != len(wanted[1]):
        problems.append(f"{len(got[1])} rows instead of {len(wanted[1])}")
    unequal = [(g, w) for g, w in zip(got[1], wanted[1]) if g != w]
    if unequal:
        problems.append(f"{len(unequal)} unequal rows of {len(wanted[1])}, first {got[0]}: {unequal[0][0]} instead of {unequal[0][1]}")
    return problems
