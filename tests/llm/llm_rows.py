"""Rows of the driver's tables, without Spark."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of(table: str, sf: str = SF) -> list[tuple]:
    return duckdb.sql(f"select * from '{sf}/{table}.parquet'").fetchall()
