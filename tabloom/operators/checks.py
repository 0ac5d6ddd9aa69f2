"""Rules that cells must keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import numbers, text
from tabloom.plans import names, specs
from tabloom.plans.names import col
from tabloom.plans.ordered import order_of

INT = r"\A[+-]?[0-9]+\z"
#: One @ with something before it, and behind it a last dot with something on both sides.
EMAIL = r"(?U)\A[^@\s]+@[^@\s]+[.][^@\s.]+\z"
DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _broken(rule: str, c: Column) -> Column:
    """Whether a trimmed, filled cell breaks the rule."""
    return {
        "int": ~c.rlike(INT), "number": numbers.floating(c).isNull(), "email": ~c.rlike(EMAIL),
        "date": ~c.rlike(DATE) | F.try_to_date(c, "yyyy-MM-dd").isNull(),
    }[rule]


def check(df: DataFrame, rules: Sequence[str], order: str | Sequence[str] | None = None) -> DataFrame:
    """The problems: (order columns, rule, column, value, message, first), in the rows' order and then the rules'.

    Blank cells break no rule but ``required``.  ``first`` is where a repeated value of
    a unique column stands first: the first of the order columns.
    """
    parsed = [specs.rule(r) for part in ([rules] if isinstance(rules, str) else rules) for r in part.split(",") if r.strip()]
    names.require([c for c, _ in parsed], df.columns)
    order = order_of(df, order)
    rows, firsts = df, {}
    for i, (c, rule) in enumerate(parsed):
        if rule == "unique":
            # a join can split a value that many rows share; only repeated values are looked up
            value = text.filled(col(c))
            many = df.where(value.isNotNull()).groupBy(value.alias(f"__u{i}")).agg(F.min(F.struct(*[col(o) for o in order])).alias(f"__first{i}"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
            rows = rows.join(many, text.filled(col(c)) == F.col(f"__u{i}"), "left")
            firsts[i] = F.col(f"__first{i}")
    here = F.struct(*[col(o) for o in order])
    found = []
    for i, (c, rule) in enumerate(parsed):
        value = text.strip(text.cell(col(c)))
        if rule == "required":
            bad, message, first = value == "", F.lit("is empty"), F.lit(None)
        elif rule == "unique":
            bad, message, first = firsts[i].isNotNull() & (firsts[i] != here), F.concat(F.lit("repeats '"), value, F.lit("'")), firsts[i][order[0]]
        else:
            bad, message, first = (value != "") & _broken(rule, value), F.concat(F.lit("'"), value, F.lit(f"' is not a valid {rule}")), F.lit(None)
        kind = df.schema[order[0]].dataType
        found.append(F.when(bad, F.struct(F.lit(i).alias("__at"), F.lit(rule).alias("rule"), F.lit(c).alias("column"), value.alias("value"), message.alias("message"), first.cast(kind).alias("first"))))
    out = rows.select(*[col(o) for o in order], F.explode(F.array_compact(F.array(*found))).alias("__p")).select(*[col(o) for o in order], "__p.*")
    return out.orderBy(*[col(o) for o in order], "__at").drop("__at")
