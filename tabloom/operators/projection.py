"""Columns chosen, renamed, cleaned, split, merged; tables stacked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators import dedup
from tabloom.plans import names
from tabloom.plans.names import NameProblem, col
from tabloom.plans.result import Result


def cut(df: DataFrame, keep: str | Sequence[str] | None = None, drop: str | Sequence[str] | None = None, rename: Sequence[str] = ()) -> DataFrame:
    """Keep columns in the order named (repeats allowed), or drop some; then rename by ``old=new``."""
    if keep and drop:
        raise NameProblem("keep or drop columns, not both")
    there = df.columns
    if keep:
        chosen = names.require(names.listed(keep), there)
    else:
        gone = set(names.require(names.listed(drop or []), there))
        chosen = [c for c in there if c not in gone]
    if not chosen:
        raise NameProblem("no columns are left")
    return df.select(*[col(c) for c in chosen]).toDF(*names.renamed(chosen, rename))


def clean(df: DataFrame, drop_repeats: bool = False, order: str | Sequence[str] | None = None) -> DataFrame:
    """Snake-case unique headers, trimmed cells, no rows of blanks alone; with ``drop_repeats`` the first of equal rows stays."""
    aside = [c for c in df.columns if c.startswith("_")]
    own = [c for c in df.columns if c not in aside]
    new = names.clean_headers(own)
    out = df.select(*[text.strip(text.cell(col(c))).alias(n) for c, n in zip(own, new)], *[col(c) for c in aside])
    if own:
        out = out.where(reduce(lambda a, b: a | b, [col(n) != "" for n in new]))
    return dedup.unique(out, new, order=order) if drop_repeats else out


def with_source(df: DataFrame, source: str, name: str = "source") -> DataFrame:
    """The table's name as its first column."""
    return df.select(F.lit(source).alias(name), *[col(c) for c in df.columns])


def stack(tables: Sequence[tuple[str, DataFrame]], union: bool = False, source: str | None = None) -> DataFrame:
    """All rows of named tables.  Columns must be the same in any order, or with ``union`` are filled with empty cells where a table has none."""
    if not tables:
        raise NameProblem("no tables")
    first_name, first = tables[0]
    for name, df in tables:
        names.no_repeats(df.columns, f"column(s) in {name}")
    every = list(dict.fromkeys(c for _, df in tables for c in df.columns))
    if source and source in every:
        raise NameProblem(f"there is a column {source} already")
    for name, df in tables[1:] if not union else []:
        missing = [c for c in first.columns if c not in df.columns]
        extra = [c for c in df.columns if c not in first.columns]
        if missing or extra:
            parts = [f"missing {', '.join(missing)}"] * bool(missing) + [f"extra {', '.join(extra)}"] * bool(extra)
            raise NameProblem(f"{name} has other columns than {first_name}: {'; '.join(parts)}")
    lacking = {c for c in every if any(c not in df.columns for _, df in tables)}
    parts = []
    for name, df in tables:
        cells = [(text.cell(col(c)) if c in df.columns else F.lit("")).alias(c) if c in lacking else col(c) for c in every]
        out = df.select(*cells)
        parts.append(with_source(out, name, source) if source else out)
    return reduce(DataFrame.unionByName, parts)


def _placed(columns: Sequence[str], at: int, new: Sequence[str], gone: Sequence[str]) -> list[str]:
    return [c for c in columns[:at] if c not in gone] + list(new) + [c for c in columns[at:] if c not in gone]


def split_column(df: DataFrame, column: str, into: Sequence[str], sep: str | None = None, from_right: bool = False, keep: bool = False) -> Result:
    """One column as several, by a separator or white space; missing parts are empty (at the left if split from the right).

    The new columns take the column's place, or follow it with ``keep``.  Counter
    ``short``: cells that are not blank and have fewer parts.
    """
    names.require([column], df.columns)
    into = [n.strip() for n in into]
    if len(into) < 2 or not all(into):
        raise NameProblem("split into two columns or more")
    at = df.columns.index(column)
    out = _placed(df.columns, at + keep, into, [] if keep else [column])
    names.no_repeats(out)
    made = dict(zip(into, text.padded_parts(col(column), len(into), sep, from_right)))
    found = text.parts(col(column), len(into), sep, from_right)
    short = df.agg(F.count_if((F.size(found) > 0) & (F.size(found) < len(into))).alias("n"))
    return Result(df.select(*[(made[c] if c in made else col(c)).alias(c) for c in out]), counters={"short": short})


def merge_columns(df: DataFrame, columns: str | Sequence[str], name: str, sep: str = " ", keep_blank: bool = False, keep: bool = False) -> DataFrame:
    """Several columns, in the order named, as one at the first of their places; after the last of them with ``keep``."""
    chosen = names.require(names.listed(columns), df.columns)
    if len(set(chosen)) < 2:
        raise NameProblem("merge two columns or more")
    places = [df.columns.index(c) for c in chosen]
    at = max(places) + 1 if keep else min(places)
    out = _placed(df.columns, at, [name], [] if keep else chosen)
    names.no_repeats(out)
    value = text.merged([col(c) for c in chosen], sep, keep_blank)
    return df.select(*[value.alias(c) if c == name else col(c) for c in out])
