"""One row of each key, or the rows whose key repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.plans import names
from tabloom.plans.names import col
from tabloom.plans.ordered import order_of

_KEY = "__k{}"


def _keyed(df: DataFrame, keys: Sequence[str], ignore_case: bool, exact_case: bool) -> tuple[DataFrame, list[str]]:
    def key(name: str) -> Column:
        value = text.strip(text.cell(col(name)))
        return text.folded(value, exact_case) if ignore_case else value

    inner = [_KEY.format(i) for i in range(len(keys))]
    return df.withColumns({k: key(n) for k, n in zip(inner, keys)}), inner


def unique(df: DataFrame, keys: str | Sequence[str] | None = None, keep: str = "first", ignore_case: bool = False, count: str | None = None, order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """The first or last row of each key; keys are compared trimmed, blanks equal blanks.

    ``count`` names a column for the number of rows with the key.  Only each task's
    own best row of a key is shuffled, however many rows share it.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    chosen = names.require(names.listed(keys), df.columns) if keys else [c for c in df.columns if not c.startswith("_")]
    if count and count in df.columns:
        raise names.NameProblem(f"there is a column {count} already")
    ways = [col(c).asc() if keep == "first" else col(c).desc() for c in order_of(df, order)]
    rows, inner = _keyed(df, chosen, ignore_case, exact_case)
    best = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*inner).orderBy(*ways))).where("__rank = 1").drop("__rank")
    if count:
        best = best.join(rows.groupBy(*inner).agg(F.count(F.lit(1)).alias(count)), inner)
    return best.select(*[col(c) for c in df.columns], *([col(count)] if count else []))


def repeated(df: DataFrame, keys: str | Sequence[str], ignore_case: bool = False, exact_case: bool = True, count: str | None = None) -> DataFrame:
    """All rows whose key is there more than once."""
    chosen = names.require(names.listed(keys), df.columns)
    if count and count in df.columns:
        raise names.NameProblem(f"there is a column {count} already")
    rows, inner = _keyed(df, chosen, ignore_case, exact_case)
    # a join can split a key with many rows, a window cannot
    many = rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return rows.join(many, inner).select(*[col(c) for c in df.columns], *([F.col("__n").alias(count)] if count else []))
