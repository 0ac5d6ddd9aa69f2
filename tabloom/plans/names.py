"""Column names: exact, case-sensitive, with errors that list what there is."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column
from pyspark.sql import functions as F


class NameProblem(ValueError):
    """A column that is not there, is there twice, or is in the way."""


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def listed(parts: str | Iterable[str]) -> list[str]:
    """Names out of comma-separated lists, trimmed, blanks left out."""
    parts = [parts] if isinstance(parts, str) else parts
    return [name for part in parts for name in map(str.strip, part.split(",")) if name]


def require(wanted: Sequence[str], there: Sequence[str]) -> list[str]:
    """The wanted names, all of which must be there."""
    if missing := [name for name in dict.fromkeys(wanted) if name not in there]:
        raise NameProblem(f"unknown column(s): {', '.join(missing)}; available: {', '.join(there)}")
    return list(wanted)


def in_table_order(wanted: str | Iterable[str], there: Sequence[str]) -> list[str]:
    """Listed names without repeats, in the table's order."""
    names = set(require(listed(wanted), there))
    return [name for name in there if name in names]


def globbed(patterns: Iterable[str], there: Sequence[str], leave: Iterable[str] = ()) -> list[str]:
    """Columns that match case-sensitive patterns, first match first, less those to leave out."""
    out: dict[str, None] = {}
    for pattern in patterns:
        hits = [name for name in there if name not in leave and fnmatchcase(name, pattern)]
        if not hits:
            raise NameProblem(f"no column matches {pattern!r}; available: {', '.join(there)}")
        out.update(dict.fromkeys(hits))
    return list(out)


def no_repeats(names: Sequence[str], what: str = "column name(s)") -> None:
    if repeated := sorted({n for n in names if list(names).count(n) > 1}):
        raise NameProblem(f"duplicate {what}: {', '.join(repeated)}")


def snake(name: str) -> str:
    """Letters and digits in lower case, all else as single underscores; a capital after a small letter starts a word."""
    joined = re.sub("[^0-9A-Za-z]+", "_", name.strip())
    return re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", joined).strip("_").lower()


def clean_headers(names: Sequence[str]) -> list[str]:
    """Snake-case names, made unique by _2, _3 ...; a name without letters becomes column_<place>."""
    out: list[str] = []
    for place, raw in enumerate(names, 1):
        base = snake(raw) or f"column_{place}"
        tries = (base if k == 1 else f"{base}_{k}" for k in range(1, len(names) + 2))
        out.append(next(t for t in tries if t not in out))
    return out


def renamed(columns: Sequence[str], specs: Iterable[str]) -> list[str]:
    """Columns after ``old=new`` specs, applied at once so that names can be swapped."""
    to: dict[str, str] = {}
    for spec in specs:
        old, eq, new = (x.strip() for x in spec.partition("="))
        if not eq or not old or not new:
            raise NameProblem(f"bad rename {spec!r}: use old=new")
        if old in to:
            raise NameProblem(f"{old} is renamed twice")
        to[old] = new
    require(list(to), columns)
    out = [to.get(c, c) for c in columns]
    if to:
        no_repeats(out)
    return out
