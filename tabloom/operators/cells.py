"""Cells rewritten by column: numbers, rounding, bins, dates, masks, replacements; with the problems found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import dates, numbers, text
from tabloom.plans import names, specs
from tabloom.plans.names import col
from tabloom.plans.ordered import ORDINAL
from tabloom.plans.result import Result


def _rewritten(df: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    return df.select(*[made[c].alias(c) if c in made else col(c) for c in df.columns])


def _problems(df: DataFrame, bad: Mapping[str, tuple[Column, str]], order: Sequence[str]) -> DataFrame:
    """(order columns, column, value, message) of cells whose condition holds."""
    order = list(order) or [c for c in ("_line", ORDINAL) if c in df.columns]
    found = [F.when(cond, F.struct(F.lit(c).alias("column"), text.cell(col(c)).alias("value"), F.lit(message).alias("message"))) for c, (cond, message) in bad.items()]
    rows = df.select(*[col(o) for o in order], F.explode(F.array_compact(F.array(*found))).alias("__p"))
    return rows.select(*[col(o) for o in order], "__p.*")


def _or_kept(c: str, new: Column) -> Column:
    return F.coalesce(new, text.cell(col(c)))


def numbers_of(df: DataFrame, columns: str | Sequence[str], mark: str = "auto", order: Sequence[str] = ()) -> Result:
    """Locale numbers as plain ones; what cannot be read, or is not clear, stays and is a problem."""
    chosen = names.in_table_order(columns, df.columns)
    made = {c: numbers.locale_text(col(c), mark) for c in chosen}
    bad = {c: (made[c].isNull() & ~text.is_blank(col(c)), "not a clear number") for c in chosen}
    return Result(_rewritten(df, {c: _or_kept(c, m) for c, m in made.items()}), _problems(df, bad, order))


def rounded(df: DataFrame, columns: str | Sequence[str], places: int = 2, mode: str = "half-up", order: Sequence[str] = ()) -> Result:
    """Plain decimals rounded exactly; other cells stay and are problems, unless blank."""
    chosen = names.in_table_order(columns, df.columns)
    made = {c: numbers.rounded(col(c), places, mode) for c in chosen}
    bad = {c: (made[c].isNull() & ~text.is_blank(col(c)), "not a plain number") for c in chosen}
    return Result(_rewritten(df, {c: _or_kept(c, m) for c, m in made.items()}), _problems(df, bad, order))


def binned(df: DataFrame, column: str, edges: str, into: str | None = None, labels: Sequence[str] | None = None, right: bool = False, open_ends: bool = False, order: Sequence[str] = ()) -> Result:
    """The label of the bin of each number, in a new column behind it; empty if blank or a problem.

    Counter table ``bins`` (label, count): each label in order, also those without rows.
    """
    names.require([column], df.columns)
    into = into or f"{column}_bin"
    names.no_repeats([*df.columns, into])
    values, written = specs.edges(edges)
    own = list(labels) if labels else specs.labels(written, right, open_ends)
    if len(own) != len(values) - 1 + 2 * open_ends:
        raise specs.SpecProblem(f"{len(values) - 1 + 2 * open_ends} labels are needed, {len(own)} given")
    number = col(column).cast("decimal(38,18)") if isinstance(df.schema[column].dataType, T.NumericType) else numbers.plain(col(column))
    label = numbers.bin_label(number, values, own, right, open_ends)
    at = df.columns.index(column) + 1
    out = df.select(*[col(c) for c in df.columns[:at]], F.coalesce(label, F.lit("")).alias(into), *[col(c) for c in df.columns[at:]])
    full = ~text.is_blank(col(column))
    outside = F.when(number.isNull(), F.lit("not a plain number")).otherwise(F.lit("outside the edges"))
    places = list(order) or [c for c in ("_line", ORDINAL) if c in df.columns]
    problems = df.where(full & label.isNull()).select(*[col(o) for o in places], F.lit(column).alias("column"), text.cell(col(column)).alias("value"), outside.alias("message"))
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(own))], "place int, label string")
    counts = out.groupBy(F.col(f"`{into}`").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    table = listed.join(counts, "label", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("count")).orderBy("place").drop("place")
    return Result(out, problems, {"bins": table})


def dated(df: DataFrame, columns: str | Sequence[str], month_first: bool = False, order: Sequence[str] = ()) -> Result:
    """Dates as ISO text; what is no date stays and is a problem, unless blank."""
    chosen = names.in_table_order(columns, df.columns)
    parsed = {c: dates.parsed(col(c), month_first) for c in chosen}
    bad = {c: (p.isNull() & ~text.is_blank(col(c)), "not a date") for c, p in parsed.items()}
    return Result(_rewritten(df, {c: dates.normalised(col(c), month_first) for c in chosen}), _problems(df, bad, order))


def masked(df: DataFrame, masks: Sequence[str], salt: str = "", keep: int = 4, ignore_case: bool = False) -> DataFrame:
    """Cells of ``column[:mode]`` hidden: hash (a token), mask (stars), email (a token and the domain), blank."""
    parsed = [specs.mask(m) for part in ([masks] if isinstance(masks, str) else masks) for m in part.split(",") if m.strip()]
    names.require([c for c, _ in parsed], df.columns)
    names.no_repeats([c for c, _ in parsed], "mask(s) of")
    how = {
        "hash": lambda c: text.hash_token(c, salt, ignore_case), "mask": lambda c: text.masked(c, keep),
        "email": lambda c: text.email_token(c, salt, ignore_case), "blank": lambda c: F.lit(""),
    }
    return _rewritten(df, {c: how[mode](col(c)) for c, mode in parsed})


def replaced(df: DataFrame, pattern: str, replacement: str, columns: str | Sequence[str] | None = None, literal: bool = False, ignore_case: bool = False, whole: bool = False) -> Result:
    """Matches replaced in the columns, all text columns without a list.  Counter table ``changed``: a column for each, with its changed cells."""
    own = [c for c in df.columns if not c.startswith("_")]
    chosen = names.in_table_order(columns, df.columns) if columns else own
    made = {c: text.replaced(col(c), pattern, replacement, literal, ignore_case, whole) for c in chosen}
    changed = df.agg(*[F.count_if(made[c] != text.cell(col(c))).alias(c) for c in chosen])
    return Result(_rewritten(df, made), counters={"changed": changed})
