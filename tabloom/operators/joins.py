"""Equi joins on trimmed keys, and keyed differences of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.plans import names
from tabloom.plans.names import NameProblem, col
from tabloom.plans.result import Result


class KeyProblem(ValueError):
    """A key that must be there once is there more often."""


def _key(c: Column, ignore_case: bool, exact_case: bool) -> Column:
    value = text.strip(text.cell(c))
    return text.folded(value, exact_case) if ignore_case else value


def _typed(left: DataFrame, a: str, right: DataFrame, b: str) -> bool:
    kinds = (left.schema[a].dataType, right.schema[b].dataType)
    return kinds[0] == kinds[1] and kinds[0].simpleString() != "string"


def join(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, how: str = "inner", ignore_case: bool = False, suffix: str = "_right", exact_case: bool = True, order: Sequence[str] = (), right_order: Sequence[str] = ()) -> Result:
    """Join on a key of each side; blank keys are equal, the right key is left out, clashing right columns get a suffix.

    With ``left`` the cells of rows without a partner are empty text (null where a
    column is not text).  Keys of one type that is not text are compared as they are.
    Which side is sent to which is left to Spark, by the sides' sizes, and a hot key is
    split by adaptive execution.  Sorted by the orders, if given.  Counter
    ``unmatched``: left rows without a partner.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how!r}")
    right_key = right_key or key
    names.require([key], left.columns)
    names.require([right_key], right.columns)
    if _typed(left, key, right, right_key) and not ignore_case:
        lk, rk = col(key), col(right_key)
    else:
        lk, rk = _key(col(key), ignore_case, exact_case), _key(col(right_key), ignore_case, exact_case)
    theirs = [c for c in right.columns if c != right_key and c not in right_order]
    named = [c + suffix if c in left.columns else c for c in theirs]
    names.no_repeats([*left.columns, *named])
    a = left.withColumn("__k", lk)
    places = [f"__o{i}" for i in range(len(right_order))]
    b = right.select(rk.alias("__k"), F.lit(True).alias("__hit"), *[col(c).alias(n) for c, n in zip(theirs, named)], *[col(c).alias(p) for c, p in zip(right_order, places)])
    both = a.join(b, a["__k"].eqNullSafe(b["__k"]) if _typed(left, key, right, right_key) and not ignore_case else a["__k"] == b["__k"], how)
    if how == "left":
        both = both.withColumns({n: F.when(F.col("__hit"), col(n)).otherwise(F.lit("")) for n, c in zip(named, theirs) if right.schema[c].dataType.simpleString() == "string"})
    if order or right_order:
        both = both.orderBy(*[col(c) for c in order], *places)
    lost = a.join(b.select("__k"), a["__k"].eqNullSafe(b["__k"]) if _typed(left, key, right, right_key) and not ignore_case else a["__k"] == b["__k"], "left_anti")
    return Result(both.select(*[a[f"`{c}`"] for c in left.columns], *[col(n) for n in named]), counters={"unmatched": lost.agg(F.count(F.lit(1)).alias("n"))})


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """One job: an error if a key is there twice."""
    cells = [text.strip(text.cell(col(k))).alias(f"k{i}") for i, k in enumerate(keys)]
    first = df.groupBy(*cells).count().where("count > 1").drop("count").orderBy(*[f"k{i}" for i in range(len(keys))]).first()
    if first is not None:
        raise KeyProblem(f"duplicate key {', '.join(map(repr, first))} in {what}")


def diff(old: DataFrame, new: DataFrame, keys: str | Sequence[str], check: bool = True) -> Result:
    """Rows added (+), removed (-), changed (~) and unchanged (=), by key.

    Columns: op, the keys (trimmed), and changes: (column, old, new) of each changed
    cell, in the old table's column order.  Only columns of both tables are compared,
    trimmed.  Counters: added, removed, changed, unchanged; the tally
    has all of them as one row, which costs one job.  With ``check`` a repeated
    key is an error; it needs a job for each table.
    """
    keys = names.listed(keys)
    names.require(keys, old.columns)
    names.require(keys, new.columns)
    if check:
        require_unique(old, keys, "old file")
        require_unique(new, keys, "new file")
    both = [c for c in old.columns if c in new.columns and c not in keys and not c.startswith("_")]
    cells = lambda df, side: df.select(
        *[text.strip(text.cell(col(k))).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias(f"__{side}"), *[text.strip(text.cell(col(c))).alias(f"__{side}{i}") for i, c in enumerate(both)]
    )
    joined = cells(old, "a").join(cells(new, "b"), [f"__k{i}" for i in range(len(keys))], "full")
    kind = "struct<column:string,old:string,new:string>"
    changed = F.array_compact(F.array(*[F.when(F.col(f"__a{i}") != F.col(f"__b{i}"), F.struct(F.lit(c).alias("column"), F.col(f"__a{i}").alias("old"), F.col(f"__b{i}").alias("new"))) for i, c in enumerate(both)])) if both else F.array().cast(f"array<{kind}>")
    op = F.when(F.col("__a").isNull(), "+").when(F.col("__b").isNull(), "-").when(F.size("changes") > 0, "~").otherwise("=")
    out = joined.withColumn("changes", changed).select(op.alias("op"), *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "changes")
    tally = out.agg(*[F.count_if(F.col("op") == sign).alias(name) for name, sign in (("added", "+"), ("removed", "-"), ("changed", "~"), ("unchanged", "="))])
    counters = {name: tally.select(name) for name in tally.columns}
    return Result(out, counters=counters, tally=tally)


def column_changes(old: DataFrame, new: DataFrame) -> tuple[list[str], list[str]]:
    """(columns added, columns removed)."""
    if not old.columns or not new.columns:
        raise NameProblem("a table without columns")
    return [c for c in new.columns if c not in old.columns], [c for c in old.columns if c not in new.columns]
