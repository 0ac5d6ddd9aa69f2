"""Stable sorts by several keys, and the first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import numbers, text
from tabloom.plans import names, specs
from tabloom.plans.names import col
from tabloom.plans.ordered import order_of


def all_numeric(df: DataFrame, columns: Sequence[str], underscores: bool = False) -> dict[str, bool]:
    """Which columns hold numbers alone, blanks aside, and one at least: one pass for all text columns."""
    typed = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in columns}
    ask = [c for c in columns if not typed[c]]
    if ask:
        tests = []
        for i, c in enumerate(ask):
            full = ~text.is_blank(col(c))
            tests += [F.count_if(full).alias(f"f{i}"), F.count_if(full & numbers.floating(col(c), underscores).isNull()).alias(f"t{i}")]
        row = df.agg(*tests).first()
        typed |= {c: row[f"f{i}"] > 0 and row[f"t{i}"] == 0 for i, c in enumerate(ask)}
    return typed


def sort(df: DataFrame, keys: str | Sequence[str], ignore_case: bool = True, reverse: bool = False, order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """Sort by ``column[:asc|:desc]`` keys.

    A column of numbers alone is sorted by number, others as folded text; blanks come
    last both ways, and equal rows keep their order, also when descending.  Columns of
    a number type need no look at the data.
    """
    keys = [keys] if isinstance(keys, str) else keys
    parsed = [specs.sort_key(k.strip(), df.columns) for part in keys for k in ([part] if part in df.columns else part.split(",")) if k.strip()]
    names.require([c for c, _ in parsed], df.columns)
    numeric = all_numeric(df, list(dict.fromkeys(c for c, _ in parsed)), underscores=True)
    ways = []
    for c, descending in parsed:
        if isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = col(c)
        elif numeric[c]:
            value = numbers.floating(col(c), underscores=True)
        else:
            value = text.filled(col(c))
            value = text.folded(value, exact_case) if ignore_case else value
        ways.append(value.desc_nulls_last() if descending != reverse else value.asc_nulls_last())
    return df.orderBy(*ways, *[col(c).asc() for c in order_of(df, order)])


def head(df: DataFrame, n: int, order: str | Sequence[str] | None = None) -> DataFrame:
    """The first n rows in the order; all of them with 0."""
    out = df.orderBy(*[col(c) for c in order_of(df, order)])
    return out.limit(n) if n else out
