"""Tables cut into parts: so many rows each, or by a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.plans import names, ordered
from tabloom.plans.names import col


def by_rows(df: DataFrame, rows: int, name: str = "part", order: str | Sequence[str] | None = None) -> DataFrame:
    """df with the number (from 1) of the part of ``rows`` rows that each row falls in."""
    if rows < 1:
        raise ValueError("a part has one row or more")
    out = ordered.numbered(df, ordered.order_of(df, order), name)
    return out.withColumn(name, F.floor(col(name) / rows).cast("long") + 1)


def by_value(df: DataFrame, column: str, name: str = "part", order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """df with the file name of each row's value: safe characters, the first spelling of those equal but for case."""
    names.require([column], df.columns)
    rows = df.withColumn("__name", text.safe_name(text.cell(col(column)))).withColumn("__fold", text.folded(F.col("__name"), exact_case))
    place = F.struct(*[col(c) for c in ordered.order_of(df, order)])
    first = rows.groupBy("__fold").agg(F.min_by("__name", place).alias(name))
    return rows.join(first, "__fold").drop("__fold", "__name")
