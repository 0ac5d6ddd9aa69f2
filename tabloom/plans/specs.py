"""The small languages of conditions, aggregates, rules, sort keys, masks, edges, sizes and paths."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal


class SpecProblem(ValueError):
    """A specification that cannot be read."""


OPERATORS = ("!=", ">=", "<=", "!~", "=", ">", "<", "~")


@dataclass(frozen=True)
class Condition:
    """``column OP value``; ``number`` is the value as a number, if it is one."""

    column: str
    op: str
    value: str
    number: float | None


def float_text(text: str, underscores: bool = False) -> float | None:
    """A finite number as floating-point text has it, or None."""
    t = text.strip()
    if "_" in t and not underscores:
        return None
    try:
        value = float(t)
    except ValueError:
        return None
    return value if value - value == 0 else None


def condition(text: str) -> Condition:
    """Read ``column OP value``: the first operator counts, the longest at its place; both sides are trimmed."""
    places = [(text.find(op, 1), -len(op), op) for op in OPERATORS]
    places = [p for p in places if p[0] > 0 and text[: p[0]].strip()]
    if not places:
        raise SpecProblem(f"bad condition {text!r}: use column OP value with one of {' '.join(OPERATORS)}")
    at, _, op = min(places)
    column, value = text[:at].strip(), text[at + len(op) :].strip()
    number = float_text(value, underscores=True)
    if op in (">", ">=", "<", "<=") and number is None:
        raise SpecProblem(f"{op} needs a number, got {value!r}")
    if op in ("~", "!~"):
        try:
            re.compile(value)
        except re.error as bad:
            raise SpecProblem(f"bad pattern {value!r}: {bad}") from None
    return Condition(column, op, value, number)


AGGREGATES = ("sum", "mean", "median", "min", "max", "distinct")


@dataclass(frozen=True)
class Aggregate:
    func: str
    column: str | None = None

    @property
    def label(self) -> str:
        return self.func if self.column is None else f"{self.column}_{self.func}"


def aggregate(text: str) -> Aggregate:
    """``count``, or ``column:func`` cut at the last colon."""
    text = text.strip()
    if text == "count":
        return Aggregate("count")
    column, _, func = (x.strip() for x in text.rpartition(":"))
    if not column or func.lower() not in AGGREGATES:
        raise SpecProblem(f"bad aggregate {text!r}: count, or column:func with func one of {', '.join(AGGREGATES)}")
    return Aggregate(func.lower(), column)


RULES = ("required", "unique", "int", "number", "date", "email")


def rule(text: str) -> tuple[str, str]:
    """``column:rule`` cut at the last colon."""
    column, _, name = (x.strip() for x in text.rpartition(":"))
    if not column:
        raise SpecProblem(f"bad rule {text!r}: use column:rule")
    if name.lower() not in RULES:
        raise SpecProblem(f"no rule {name!r} (in {text!r}); there are {', '.join(RULES)}")
    return column, name.lower()


def sort_key(text: str, columns: Sequence[str]) -> tuple[str, bool]:
    """(column, descending) of ``column[:asc|:desc]``; a column that is called so wins."""
    if text in columns:
        return text, False
    name, colon, way = text.rpartition(":")
    if colon and way.lower() in ("asc", "desc"):
        return name, way.lower() == "desc"
    return text, False


MASKS = ("hash", "mask", "email", "blank")


def mask(text: str) -> tuple[str, str]:
    """(column, mode) of ``column[:mode]`` cut at the first colon; hash if no mode is given."""
    column, _, mode = (x.strip() for x in text.partition(":"))
    if (mode or "hash") not in MASKS:
        raise SpecProblem(f"no mode {mode!r} for {column}; there are {', '.join(MASKS)}")
    return column, mode or "hash"


PLAIN_DECIMAL = r"[+-]?(\d+(\.\d*)?|\.\d+)"


def edges(text: str) -> tuple[list[Decimal], list[str]]:
    """(numbers, as written) of two or more increasing numbers."""
    written = [p for p in map(str.strip, text.split(",")) if p]
    if len(written) < 2:
        raise SpecProblem("edges: give two numbers or more, such as 0,18,65")
    for w in written:
        if not re.fullmatch(PLAIN_DECIMAL, w):
            raise SpecProblem(f"edges: {w!r} is not a plain number")
    numbers = [Decimal(w) for w in written]
    if sorted(set(numbers)) != numbers:
        raise SpecProblem("edges: each must be larger than the one before")
    return numbers, written


def labels(written: Sequence[str], right: bool = False, open_ends: bool = False) -> list[str]:
    """The names of the bins between edges, and beyond them with open ends."""
    shape = "({}, {}]" if right else "[{}, {})"
    inner = [shape.format(a, b) for a, b in zip(written[:-1], written[1:])]
    if not open_ends:
        return inner
    below, above = ("<=", ">") if right else ("<", ">=")
    return [f"{below} {written[0]}", *inner, f"{above} {written[-1]}"]


def widths(text: str) -> list[int]:
    parts = [p for p in map(str.strip, text.split(",")) if p]
    if not parts or not all(p.isdigit() and int(p) > 0 for p in parts):
        raise SpecProblem(f"widths: give positive whole numbers, not {text!r}")
    return [int(p) for p in parts]


def byte_size(text: str) -> int:
    """Bytes of ``1.5M``, ``10k`` or ``300``; units are binary."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*", text, re.IGNORECASE)
    if not m:
        raise SpecProblem(f"bad size {text!r}: use a number and K, M, G or T")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2].lower() or " "))


def human_size(n: int) -> str:
    """Bytes as ``512B``, ``1.5K``, ``2.0M`` or ``3.1G``: the largest binary unit of which there is one or more."""
    power = min(3, max(0, (int(n).bit_length() - 1) // 10))
    return f"{n / 1024**power:.1f}{'BKMG'[power]}" if power else f"{n}B"


DELIMITERS = {"tab": "\t", "\\t": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def delimiter(text: str) -> str:
    """One character, or the name of one."""
    found = DELIMITERS.get(text.lower(), text)
    if len(found) != 1:
        raise SpecProblem(f"delimiter: one character or one of {', '.join(DELIMITERS)}, not {text!r}")
    return found


def json_path(text: str) -> list[str]:
    return text.split(".")
