"""Groups with exact aggregates, frequencies, and profiles of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import numbers, text
from tabloom.plans import names, specs
from tabloom.plans.names import col
from tabloom.plans.ordered import ORDINAL
from tabloom.plans.result import Refused

BLANK = "(blank)"


def _decimal(df: DataFrame, column: str, scale: int) -> Column:
    if isinstance(df.schema[column].dataType, T.NumericType):
        return col(column).cast(f"decimal(38,{scale})")
    return numbers.exact(col(column), scale)


def not_numbers(df: DataFrame, columns: Sequence[str], order: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """(order columns, column, value, number) of cells that are neither blank nor a number; with a scale also numbers that it does not hold exactly."""
    found = []
    for c in columns:
        number = numbers.floating(col(c)).isNotNull()
        bad = ~number if scale is None else ~number | numbers.exact(col(c), scale).isNull() | (numbers.written_scale(col(c)) > scale)
        found.append(F.when(~text.is_blank(col(c)) & bad, F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"), number.alias("number"))))
    return df.select(*[col(c) for c in order], F.explode(F.array_compact(F.array(*found))).alias("__x")).select(*[col(c) for c in order], "__x.*")


def group(df: DataFrame, keys: str | Sequence[str], aggregates: Sequence[str] = ("count",), precision: int = 2, scale: int = 6, check: bool = True, sort: bool = True, exact_case: bool = True) -> DataFrame:
    """Rows by trimmed keys, a blank key shown as (blank); count, and sum, mean, median, min, max, distinct of columns.

    Numbers are exact decimals of up to ``scale`` decimals; blanks are skipped, and a
    group without numbers has null; a number in text that ``scale`` would round is an error.  The mean is rounded half up to ``precision``.
    Distinct counts different trimmed cells.  Text that is no number is an error; to
    find it takes a job unless ``check`` is off, when it is skipped.  Sorted by the
    keys: numbers, then folded text, then (blank).
    """
    chosen = names.require(names.listed(keys), df.columns)
    parsed = [specs.aggregate(a) for a in ([aggregates] if isinstance(aggregates, str) else aggregates)]
    names.require([a.column for a in parsed if a.column], df.columns)
    names.no_repeats([*chosen, *[a.label for a in parsed]])
    numeric = list(dict.fromkeys(a.column for a in parsed if a.column and a.func != "distinct"))
    ask = [c for c in numeric if not isinstance(df.schema[c].dataType, T.NumericType)]
    place = [c for c in ("_line", ORDINAL) if c in df.columns][:1]
    if check and ask:
        found = not_numbers(df, ask, place, scale)
        if (bad := (found.orderBy(*place) if place else found).first()) is not None:
            where = f"line {bad['_line']}: " if place == ["_line"] else ""
            raise Refused(f"{where}{bad['value']!r} in column {bad['column']!r} {'has too many digits' if bad['number'] else 'is not a number'}")
    shown = [F.coalesce(text.filled(col(k)), F.lit(BLANK)).alias(f"__k{i}") for i, k in enumerate(chosen)]
    value = {c: f"__v{i}" for i, c in enumerate(numeric)}
    count = {c: f"__d{i}" for i, c in enumerate(dict.fromkeys(a.column for a in parsed if a.func == "distinct"))}
    rows = df.select(*shown, *[_decimal(df, c, scale).alias(v) for c, v in value.items()], *[text.filled(col(c)).alias(d) for c, d in count.items()])
    inner = [f"__k{i}" for i in range(len(chosen))]
    wide = f"decimal(38,{scale})"

    def made(a: specs.Aggregate) -> Column:
        if a.func == "count":
            return F.count(F.lit(1))
        if a.func == "distinct":
            return F.count_distinct(F.col(count[a.column]))
        v = F.col(value[a.column])
        if a.func == "mean":
            return F.round(F.sum(v).cast(wide).cast("decimal(38,12)") / F.nullif(F.count(v), F.lit(0)).cast("decimal(20,0)"), precision).cast(f"decimal(38,{precision})")
        return {"sum": F.sum, "min": F.min, "max": F.max}[a.func](v).cast(wide)

    plain = [made(a).alias(f"__a{i}") for i, a in enumerate(parsed) if a.func != "median"]
    out = rows.groupBy(*inner).agg(*(plain or [F.count(F.lit(1)).alias("__count")]))
    for i, a in enumerate(parsed):
        if a.func == "median":
            out = out.join(medians(rows, inner, value[a.column], f"__a{i}", scale), inner, "left")
    if sort:
        out = out.orderBy(*[way for k in inner for way in key_order(F.col(k), exact_case)])
    return out.select(*[F.col(k).alias(c) for k, c in zip(inner, chosen)], *[F.col(f"__a{i}").alias(a.label) for i, a in enumerate(parsed)])


#: Accuracy of the percentiles around a median, the share of a group aimed at between them, and the ranges that the values there are counted in.
NEAR, AROUND, RANGES = 10_000, 0.001, 4_096


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str, scale: int) -> DataFrame:
    """(keys, name): the exact median of each group, the mean of the middle two if their number is even.

    Values are counted in ranges: thousands between approximate percentiles around the
    middle, one below and one above.  Only the values of the one or two ranges that hold
    the middle are brought together, in a large group a few millionths of its different
    values; and the counts, not the percentiles, say which ranges these are.
    """
    full = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    near = F.percentile_approx(F.col("__v").cast("double"), F.array(F.lit(0.5 - AROUND / 2), F.lit(0.5 + AROUND / 2)), F.lit(NEAR))
    bounds = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), near.alias("__p"))
    x, first, last = F.col("__v").cast("double"), F.col("__p")[0], F.col("__p")[1]
    inside = F.when(last > first, F.least(F.floor((x - first) / (last - first) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    placed = full.join(bounds, keys).withColumn("__range", F.when(x < first, -1).when(x > last, RANGES).otherwise(inside).cast("int"))
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    ranges = placed.groupBy(*keys, "__range", "__n").agg(F.count(F.lit(1)).alias("__c"))
    ranges = ranges.withColumn("__end", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__range")))
    middle = ranges.where((F.col("__end") >= low) & (F.col("__end") - F.col("__c") < high)).select(*keys, "__range", (F.col("__end") - F.col("__c")).alias("__below"))
    held = placed.join(middle, [*keys, "__range"]).groupBy(*keys, "__range", "__v", "__n", "__below").agg(F.count(F.lit(1)).alias("__c"))
    held = held.withColumn("__to", F.sum("__c").over(Window.partitionBy(*keys, "__range").orderBy("__v")) + F.col("__below"))
    at = lambda place: F.min(F.when(F.col("__to") >= place, F.col("__v")))
    # of 37 digits, as a quotient of 38 keeps no digit more than they have
    return held.groupBy(*keys).agg(((at(low) + at(high)).cast(f"decimal(37,{scale})") / F.lit(2).cast("decimal(1,0)")).cast(f"decimal(38,{scale + 1})").alias(name))


def key_order(key: Column, exact_case: bool = True) -> list[Column]:
    """Ways to sort a key's values: numbers by size, then folded text, then (blank)."""
    number = numbers.floating(key)
    rank = F.when(key == BLANK, 2).when(number.isNull(), 1).otherwise(0)
    return [rank, number, text.folded(key, exact_case), key]


def freq(df: DataFrame, columns: str | Sequence[str], ignore_case: bool = False, blanks: bool = True, top: int | None = None, by_value: bool = False, share: str | None = "share", order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """Counts of the combinations of trimmed cells, most first, then by value; and the share of all in percent.

    Without case, the most common spelling is shown, of equally common ones the first.
    Combinations of blanks alone are left out without ``blanks``.  ``top`` takes the
    most common; ``by_value`` then sorts those by value, numbers first, blanks last.
    """
    chosen = names.require(names.listed(columns), df.columns)
    inner = [f"__k{i}" for i in range(len(chosen))]
    rows = df.select(*[text.strip(text.cell(col(c))).alias(k) for c, k in zip(chosen, inner)], *([col(c).alias(f"__o{i}") for i, c in enumerate(_first_by(df, order))] if ignore_case else []))
    if not blanks:
        rows = rows.where(F.concat(*inner) != "")
    if ignore_case:
        places = [c for c in rows.columns if c.startswith("__o")]
        spelled = rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*places) if places else F.struct(*inner)).alias("__first"))
        spelled = spelled.withColumns({f"__f{i}": text.folded(F.col(k), exact_case) for i, k in enumerate(inner)})
        best = F.min_by(F.struct(*inner), F.struct(-F.col("__n"), F.col("__first"), *inner))
        counted = spelled.groupBy(*[f"__f{i}" for i in range(len(inner))]).agg(F.sum("__n").alias("__count"), best.alias("__s")).select(*[F.col("__s")[k].alias(k) for k in inner], "__count")
    else:
        counted = rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("__count"))
    out = counted.select(*inner, "__count")
    if share:
        total = counted.agg(F.sum("__count").alias("__all")).scalar()
        out = out.withColumn("__share", F.round(F.col("__count") * 100 / total, 1))
    out = out.orderBy(F.desc("__count"), *inner)
    if top is not None:
        out = out.limit(top)
    if by_value:
        ways = []
        for k in inner:
            number = numbers.floating(F.col(k))
            ways += [F.when(F.col(k) == "", 2).when(number.isNull(), 1).otherwise(0), number, text.folded(F.col(k), exact_case), F.col(k)]
        out = out.orderBy(*ways)
    return out.select(*[F.col(k).alias(c) for k, c in zip(inner, chosen)], F.col("__count").alias("count"), *([F.col("__share").alias(share)] if share else []))


def _first_by(df: DataFrame, order: str | Sequence[str] | None) -> list[str]:
    if order:
        return [order] if isinstance(order, str) else list(order)
    return ["_ord"] if "_ord" in df.columns else []


def profile(df: DataFrame, columns: Sequence[str] | None = None, decimal_comma: bool = False) -> DataFrame:
    """A row for each column: filled, empty, distinct, numeric, and min, max and mean (4 decimals) if all filled cells are numbers.

    min and max of other columns are null.  One pass over the table, then a row per column.
    """
    chosen = names.require(columns, df.columns) if columns else [c for c in df.columns if not c.startswith("_")]
    aggs = []
    for i, c in enumerate(chosen):
        full = text.filled(col(c))
        typed = isinstance(df.schema[c].dataType, T.NumericType)
        number = col(c).cast("double") if typed else F.coalesce(numbers.comma_floating(col(c)), numbers.floating(col(c))) if decimal_comma else numbers.floating(col(c))
        aggs += [F.count(full).alias(f"f{i}"), F.count_distinct(full).alias(f"d{i}"), F.count(number).alias(f"n{i}"), F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.avg(number).alias(f"m{i}")]
    one = df.agg(F.count(F.lit(1)).alias("all"), *aggs)
    rows = []
    for i, c in enumerate(chosen):
        numeric = (F.col(f"f{i}") > 0) & (F.col(f"f{i}") == F.col(f"n{i}"))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"f{i}").alias("filled"), (F.col("all") - F.col(f"f{i}")).alias("empty"), F.col(f"d{i}").alias("distinct"), numeric.alias("numeric"),
            F.when(numeric, F.col(f"lo{i}")).alias("min"), F.when(numeric, F.col(f"hi{i}")).alias("max"), F.when(numeric, F.round(F.col(f"m{i}"), 4)).alias("mean"),
        ))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
