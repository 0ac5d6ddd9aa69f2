"""Lines and words of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.plans.names import col
from tabloom.plans.ordered import order_of


def lines_of(texts: DataFrame, column: str = "text", order: Sequence[str] = (), name: str = "line") -> DataFrame:
    """(order columns, _line, line): the lines of whole texts, from 1, cut as Python's splitlines does."""
    found = F.posexplode(text.lines(text.cell(col(column))))
    rows = texts.select(*[col(c) for c in order], found)
    return rows.select(*[col(c) for c in order], (F.col("pos") + 1).cast("long").alias("_line"), F.col("col").alias(name))


def _key(line: Column, ignore_case: bool, ignore_space: bool, exact_case: bool) -> Column:
    key = line
    if ignore_space:
        key = F.regexp_replace(text.strip(key), r"(?U)[\s\x1c-\x1f]+", " ")
    return text.folded(key, exact_case) if ignore_case else key


def dedupe(lines: DataFrame, column: str = "line", keep: str = "first", ignore_case: bool = False, ignore_space: bool = False, skip_blank: bool = False, counts: bool = False, order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """One line of each kind, the first or last, in order; with ``counts`` n comes first and rows are sorted by it, most first.

    Blank lines are left out with ``skip_blank``.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    order = order_of(lines, order)
    rows = lines.where(~text.is_blank(col(column))) if skip_blank else lines
    rows = rows.withColumn("__key", _key(text.cell(col(column)), ignore_case, ignore_space, exact_case))
    place = F.struct(*[col(c) for c in order])
    pick = F.min_by if keep == "first" else F.max_by
    own = F.struct(*[col(c) for c in lines.columns])
    out = rows.groupBy("__key").agg(pick(own, place).alias("r"), F.count(F.lit(1)).alias("n"))
    out = out.select(*([F.col("n")] if counts else []), "r.*")
    return out.orderBy(*([F.desc("n")] if counts else []), *[col(c) for c in order])


def repeated(lines: DataFrame, column: str = "line", ignore_case: bool = False, ignore_space: bool = False, skip_blank: bool = False, order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """Lines that are there more than once, each once with its count n, as dedupe with counts."""
    return dedupe(lines, column, "first", ignore_case, ignore_space, skip_blank, True, order, exact_case).where("n > 1")


def count_prefixed(counted: DataFrame, column: str = "line", n: str = "n") -> DataFrame:
    """Lines with their right-aligned count in front, as text for reports."""
    width = counted.agg(F.max(F.length(col(n).cast("string")))).scalar()
    return counted.withColumn(column, F.concat(F.lpad(col(n).cast("string"), width, F.lit(" ")), F.lit(" "), col(column)))


def word_counts(texts: DataFrame, column: str = "text", top: int | None = None, min_length: int = 1, min_count: int = 1, stop_words: DataFrame | None = None, order: str | Sequence[str] | None = None, exact_case: bool = True) -> DataFrame:
    """(word, count), most first, then as first seen (with an order) or by word.

    ``stop_words`` is a table of texts (column text), read by the same rule.  ``top`` is
    taken before ``min_count``.
    """
    places = ([order] if isinstance(order, str) else list(order or [])) or ([c for c in ("_ord",) if c in texts.columns])
    found = texts.select(*[col(c) for c in places], F.posexplode(text.words(text.cell(col(column)), exact_case)).alias("pos", "word")).where(F.length("word") >= min_length)
    first = F.min(F.struct(*places, "pos")) if places else F.lit(0)
    out = found.groupBy("word").agg(F.count(F.lit(1)).alias("count"), first.alias("__first"))
    if stop_words is not None:
        stops = stop_words.select(F.explode(text.words(text.cell(F.col("text")), exact_case)).alias("word")).distinct()
        out = out.join(stops, "word", "left_anti")
    out = out.orderBy(F.desc("count"), "__first", "word")
    if top is not None:
        out = out.limit(top)
    return out.where(F.col("count") >= min_count).select("word", "count")


def word_totals(texts: DataFrame, column: str = "text", exact_case: bool = True) -> DataFrame:
    """(texts, lines, words, chars, unique) of all texts together; unique counts different words."""
    value = text.cell(col(column))
    each = texts.select(F.size(text.lines(value)).alias("l"), F.length(value).alias("c"), text.words(value, exact_case).alias("w"))
    totals = each.agg(F.count(F.lit(1)).alias("texts"), F.sum("l").alias("lines"), F.sum(F.size("w")).alias("words"), F.sum("c").alias("chars"))
    unique = each.select(F.explode("w").alias("w")).agg(F.count_distinct("w").alias("n")).scalar()
    return totals.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("texts", "lines", "words", "chars")], unique.cast("long").alias("unique"))
