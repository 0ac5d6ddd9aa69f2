"""Spark's rows and DuckDB's rows of the same query, made comparable."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def value(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, Decimal)):
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    return str(x)


def counted(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def duck(sf: str, sql: str) -> tuple[list[str], list]:
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = db.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def difference(df, sf: str, sql: str) -> str:
    """What differs, or an empty text."""
    names, rows = duck(sf, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, SQL has {sorted(names)}"
    a, b = counted(df.columns, df.collect()), counted(names, rows)
    if a == b:
        return ""
    return f"{sum(a.values())} rows, SQL has {sum(b.values())}; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
