"""Text and Markdown tables of a few rows, on the driver; reports of differences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from tabloom.functions import text
from tabloom.plans import names
from tabloom.plans.names import col
from tabloom.plans.ordered import ORDINAL

NUMERIC = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?")


def width(s: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def fitted(s: str, most: int) -> str:
    """s in no more than so many columns, with an ellipsis if it is cut."""
    if width(s) <= most:
        return s
    out = ""
    for c in s:
        if width(out + c) > most - 1:
            break
        out += c
    return out + "…"


def one_line(s: str) -> str:
    return " ".join(s.split())


def rows_of(df: DataFrame, n: int = 20, columns: str | Sequence[str] | None = None) -> tuple[list[str], list[list[str]]]:
    """Header and the first n rows as text."""
    own = names.require(names.listed(columns), df.columns) if columns else [c for c in df.columns if not c.startswith("_")]
    rows = df.orderBy(ORDINAL) if ORDINAL in df.columns else df
    rows = rows.limit(n) if n else rows
    return own, [list(r) for r in rows.select(*[text.cell(col(c)) for c in own]).collect()]


def aligned(header: Sequence[str], rows: Sequence[Sequence[str]], markdown: bool = False, most: int = 40) -> str:
    """A table with numbers at the right; as Markdown, bars in cells are escaped."""
    clean = lambda s: fitted(one_line(s), most).replace("|", "\\|") if markdown else fitted(one_line(s), most)
    head, body = [clean(h) for h in header], [[clean(c) for c in [*r, *[""] * (len(header) - len(r))][: len(header)]] for r in rows]
    filled = [[r[i].strip() for r in body if r[i].strip()] for i in range(len(head))]
    right = [bool(f) and all(NUMERIC.fullmatch(c) for c in f) for f in filled]
    size = [max([3 if markdown else 1, width(h), *[width(r[i]) for r in body]]) for i, h in enumerate(head)]
    pad = lambda s, i: " " * (size[i] - width(s)) + s if right[i] else s + " " * (size[i] - width(s))
    line = lambda r: "| " + " | ".join(pad(c, i) for i, c in enumerate(r)) + " |" if markdown else "  ".join(pad(c, i) for i, c in enumerate(r)).rstrip()
    rule = "| " + " | ".join("-" * (n - 1) + (":" if right[i] else "-") for i, n in enumerate(size)) + " |" if markdown else "  ".join("-" * n for n in size)
    return "\n".join([line(head), rule, *map(line, body)])


def look(df: DataFrame, n: int = 20, columns: str | Sequence[str] | None = None, markdown: bool = False, most: int = 40) -> str:
    """The first n rows of a table as text."""
    return aligned(*rows_of(df, n, columns), markdown, most)


def diff_report(changes: DataFrame, added: Sequence[str] = (), removed: Sequence[str] = ()) -> Iterator[str]:
    """Lines of all changed rows of :func:`tabloom.operators.joins.diff`; a part of the rows at a time comes to the driver."""
    if added:
        yield f"columns added: {', '.join(added)}"
    if removed:
        yield f"columns removed: {', '.join(removed)}"
    keys = changes.columns[1:-1]
    for row in changes.where("op <> '='").orderBy("op", *[col(k) for k in keys]).toLocalIterator():
        yield f"{row['op']} {', '.join(row[k] for k in keys)}"
        yield from (f"    {c['column']}: {c['old']!r} -> {c['new']!r}" for c in row["changes"] or [])
