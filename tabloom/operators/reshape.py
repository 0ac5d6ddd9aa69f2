"""Melt, pivot, transpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text
from tabloom.plans import names
from tabloom.plans.names import NameProblem, col
from tabloom.plans.ordered import ORDINAL, order_of


def melt(df: DataFrame, ids: str | Sequence[str], values: str | Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value", skip_blank: bool = False) -> DataFrame:
    """A row for each value column of each row; value columns are names or patterns, all but the ids without any.

    Rows keep the order columns that begin with an underscore; within a row, values come
    in the columns' order.
    """
    own = [c for c in df.columns if not c.startswith("_")]
    aside = [c for c in df.columns if c not in own]
    names.no_repeats(own)
    ids = names.require(names.listed(ids), own)
    chosen = names.globbed(names.listed(values), own, ids) if values else [c for c in own if c not in ids]
    if not chosen:
        raise NameProblem("no value columns")
    names.no_repeats([*ids, var_name, value_name])
    kinds = {df.schema[c].dataType for c in chosen}
    value = (lambda c: col(c)) if len(kinds) == 1 else (lambda c: text.cell(col(c)))
    # explode keeps a row's values in order and reads the input once
    pairs = F.array(*[F.struct(F.lit(c).alias("var"), value(c).alias("val")) for c in chosen])
    out = df.select(*[col(c) for c in [*aside, *ids]], F.explode(pairs).alias("__p"))
    out = out.select(*[col(c) for c in [*aside, *ids]], F.col("__p.var").alias(var_name), F.col("__p.val").alias(value_name))
    return out.where(~text.is_blank(col(value_name))) if skip_blank else out


class PivotProblem(ValueError):
    """A pivot that is not clear."""


def pivot(df: DataFrame, column: str, value: str, ids: str | Sequence[str] | None = None, fill: str = "", keep: str | None = None, order: str | Sequence[str] | None = None, headers: Sequence[str] | None = None, most: int = 10_000) -> DataFrame:
    """A column for each value of ``column``; rows and columns in the order first seen.

    Without ids, all other columns are ids.  Two values for one cell are an error unless
    ``keep`` says first or last.  Cells without a row get ``fill``.  Unless the headers
    are given, one job finds them (at most ``most``, and checks for repeats in another).
    """
    own = [c for c in df.columns if not c.startswith("_")]
    names.no_repeats(own)
    ids = names.require(names.listed(ids), own) if ids else [c for c in own if c not in (column, value)]
    names.require([column, value], own)
    if column == value or column in ids or value in ids:
        raise NameProblem("id, column and value must be different columns")
    order = order_of(df, order)
    place = F.struct(*[col(c) for c in order])
    keys = [f"__i{i}" for i in range(len(ids))]
    rows = df.select(*[text.strip(text.cell(col(c))).alias(k) for c, k in zip(ids, keys)], text.strip(text.cell(col(column))).alias("__h"), text.cell(col(value)).alias("__v"), place.alias("__o"))
    if headers is None:
        found = rows.groupBy("__h").agg(F.min("__o").alias("o")).orderBy("o").limit(most + 1).collect()
        headers = [r["__h"] for r in found]
        if len(headers) > most:
            raise PivotProblem(f"over {most} new columns")
    if any(not h.strip() for h in headers):
        raise PivotProblem(f"a cell of {column} is blank")
    if clash := [h for h in headers if h in ids]:
        raise PivotProblem(f"new column(s) clash with ids: {', '.join(clash)}")
    if keep is None:
        twice = rows.groupBy(*keys, "__h").count().where("count > 1").first()
        if twice is not None:
            raise PivotProblem(f"more than one value for {', '.join(map(repr, list(twice)[:-1]))}")
    if keep not in (None, "first", "last"):
        raise ValueError("keep is first or last")
    pick = F.max_by if keep == "last" else F.min_by
    # cells first, each by its own key, so that a row's group stays small
    cells = rows.groupBy(*keys, "__h").agg(pick("__v", "__o").alias("__v"), F.min("__o").alias("__o"))
    made = [F.max(F.when(F.col("__h") == h, F.col("__v"))).alias(f"__c{i}") for i, h in enumerate(headers)]
    out = cells.groupBy(*keys).agg(F.min("__o").alias("__first"), *made).orderBy("__first")
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, ids)], *[F.coalesce(F.col(f"__c{i}"), F.lit(fill)).alias(h) for i, h in enumerate(headers)])


class TooLarge(ValueError):
    """A result whose width grows with the input is beyond its guard."""


def transpose_cells(rows: DataFrame, keep_trailing: bool = False, most: int = 5_000_000) -> DataFrame:
    """(_ord, cells): rows (_ord, cells) turned; short rows are padded, empty cells at the ends dropped unless kept.

    The result's rows are as wide as the input is long, so its cells are counted first
    (one job) and more than ``most`` are refused.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("w")).first()
    n, width = seen["n"], seen["w"] or 0
    if n * width > most:
        raise TooLarge(f"{n} x {width} cells are over the limit of {most}")
    padded = rows.select(ORDINAL, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda i: F.coalesce(F.get("cells", i), F.lit("")))))
    if not width:
        return rows.select(ORDINAL, "cells").limit(0)
    turned = padded.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct(ORDINAL, "col"))).alias("c")).select(F.col("pos").cast("long").alias(ORDINAL), F.col("c.col").alias("cells"))
    if not keep_trailing:
        last = F.array_max(F.transform("cells", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
        turned = turned.withColumn("cells", F.slice("cells", F.lit(1), last))
    return turned.orderBy(ORDINAL)


def transpose(df: DataFrame, order: str | Sequence[str] | None = None, most: int = 5_000_000) -> DataFrame:
    """A table turned: the first column's cells become the header, the header the first column."""
    own = [c for c in df.columns if not c.startswith("_")]
    ways = [col(c).asc() for c in order_of(df, order)]
    first = own[0]
    rows = df.count()
    if (rows + 1) * len(own) > most:
        raise TooLarge(f"{rows + 1} x {len(own)} cells are over the limit of {most}")
    table = df.orderBy(*ways).select(*[text.cell(col(c)).alias(f"c{i}") for i, c in enumerate(own)]).collect()
    header = [first, *[r[0] for r in table]]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    return df.sparkSession.createDataFrame([[c, *[r[i] for r in table]] for i, c in enumerate(own) if i], schema)
