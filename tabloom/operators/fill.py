"""Blanks filled from the rows before or after, or with a constant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.plans import names, ordered
from tabloom.plans.names import col
from tabloom.plans.result import Result


def fill(df: DataFrame, columns: str | Sequence[str] | None = None, within: str | None = None, up: bool = False, value: str | None = None, order: str | Sequence[str] | None = None) -> Result:
    """Fill blank cells with the last filled cell above (below with ``up``), or with ``value``.

    All columns without a list.  ``within`` starts anew wherever that column, itself
    filled, changes from one row to the next.  Cells are copied as they are; blanks
    before the first filled cell stay.  Counter ``filled``: cells that got a value.
    """
    own = [c for c in df.columns if not c.startswith("_")]
    chosen = names.in_table_order(columns, df.columns) if columns else own
    if within is not None:
        names.require([within], df.columns)
    blank = {c: text.is_blank(col(c)) for c in chosen}
    if value is not None:
        out = df.select(*[F.when(blank[c], F.lit(value)).otherwise(text.cell(col(c))).alias(c) if c in blank else col(c) for c in df.columns])
        return Result(out, counters={"filled": df.agg(F.coalesce(F.sum(sum(b.cast("int") for b in blank.values())), F.lit(0)).alias("n"))})
    order = ordered.order_of(df, order)
    source = lambda c: F.when(~text.is_blank(col(c)), text.cell(col(c)))
    value_of = {f"__f{i}": source(c) for i, c in enumerate(chosen) if c != within}
    rows = ordered.bucketed(df, order)
    if within is None:
        rows = ordered.carried(rows, order, value_of, up)
    else:
        rows = ordered.carried_within(rows, order, source(within), text.strip, value_of, up)
    made = {c: F.coalesce(F.col(ordered.WITHIN if c == within else f"__f{i}"), text.cell(col(c))) for i, c in enumerate(chosen)}
    got = F.lit(0)
    for c, m in made.items():
        got = got + (text.is_blank(col(c)) & ~text.is_blank(m)).cast("int")
    out = rows.select(*[made[c].alias(c) if c in made else col(c) for c in df.columns])
    return Result(out, counters={"filled": rows.agg(F.coalesce(F.sum(got), F.lit(0)).alias("n"))})
