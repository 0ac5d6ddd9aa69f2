"""Rows by conditions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import numbers, text
from tabloom.plans import names, specs
from tabloom.plans.names import col


def _compare(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def predicate(df: DataFrame, condition: str, ignore_case: bool = False, exact_case: bool = True) -> Column:
    """A condition as a column; null counts as false.

    A number column is compared as it is, so that the scan can use the filter; a
    text column by what its trimmed cells hold: numbers with numbers, else text.
    A blank matches != ; what is no number matches no order.
    """
    c = specs.condition(condition)
    names.require([c.column], df.columns)
    kind, value = df.schema[c.column].dataType, col(c.column)
    if isinstance(kind, T.NumericType) and c.number is not None and "~" not in c.op:
        found = _compare(c.op, value, F.lit(c.number))
        return found if c.op not in ("!=",) else found | value.isNull()
    cell = text.strip(text.cell(value))
    if "~" in c.op:
        found = cell.rlike(text.java_pattern(c.value, ignore_case=ignore_case))
        return ~found if c.op == "!~" else found
    number = numbers.floating(value, underscores=True)
    if c.op in (">", ">=", "<", "<="):
        return F.coalesce(_compare(c.op, number, F.lit(c.number)), F.lit(False))
    own, other = (text.folded(cell, exact_case), c.value.casefold()) if ignore_case else (cell, c.value)
    same = own == F.lit(other)
    if c.number is not None:
        same = F.when(number.isNotNull(), number == F.lit(c.number)).otherwise(same)
    return ~same if c.op == "!=" else same


def where(df: DataFrame, conditions: str | Sequence[str], any_match: bool = False, ignore_case: bool = False, exact_case: bool = True) -> DataFrame:
    """The rows for which all conditions hold, or any of them."""
    conditions = [conditions] if isinstance(conditions, str) else list(conditions)
    if not conditions:
        raise specs.SpecProblem("give a condition")
    found = [predicate(df, c, ignore_case, exact_case) for c in conditions]
    return df.where(reduce((lambda a, b: a | b) if any_match else (lambda a, b: a & b), found))
