"""Text: trimming, blanks, folding, words, masks and replacements.

A cell is a string that is never null: ``cell`` makes one of any column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.strip knows it: Unicode space, and the four separators that Java leaves out.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def cell(c: Column) -> Column:
    """Any column as text, null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, all of Unicode's."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(cell(c)) == ""


def filled(c: Column) -> Column:
    """The trimmed cell, or null if it is blank."""
    return F.nullif(strip(cell(c)), F.lit(""))


@F.arrow_udf(T.StringType())
def casefold(c: pa.Array) -> pa.Array:
    """Python's str.casefold, for which Spark has no equal: "straße" folds to "strasse"."""
    return pa.array([None if x is None else x.casefold() for x in c.to_pylist()], pa.string())


def folded(c: Column, exact: bool = True) -> Column:
    """For comparisons without case: casefold, or lower where that is known to be enough."""
    return casefold(c) if exact else F.lower(c)


@F.arrow_udf(T.StringType())
def expand_tabs(c: pa.Array) -> pa.Array:
    """Tabs as spaces up to every eighth column."""
    return pa.array([None if x is None else x.expandtabs(8) for x in c.to_pylist()], pa.string())


def snake(c: Column) -> Column:
    """Snake case of a value, as for headers."""
    joined = F.regexp_replace(strip(c), "[^0-9A-Za-z]+", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(joined, "(?<=[a-z0-9])(?=[A-Z])", "_"), "^_+|_+$", ""))


def safe_name(c: Column) -> Column:
    """A value as part of a file name: runs of other characters become one underscore."""
    kept = F.regexp_replace(F.regexp_replace(strip(c), r"(?U)[^\w.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(kept == "", F.lit("empty")).otherwise(kept)


WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def words(c: Column, exact: bool = True) -> Column:
    """The words of a text, folded: letters and digits, joined by apostrophes and hyphens."""
    found = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    return F.regexp_extract_all(folded(c, True), F.lit(WORD), F.lit(0)) if exact else F.transform(found, F.lower)


#: Line ends of Python's str.splitlines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(c: Column) -> Column:
    """The lines of a whole text; a line end at the end starts no new line."""
    parts = F.split(c, LINE_END)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def java_replacement(text: str) -> str:
    """A Python replacement as Java reads it: \\1 and \\g<name> become $1 and ${name}."""
    out, at = "", 0
    for m in re.finditer(r"\\(?:g<(\w+)>|(\d{1,2})|(.))", text, re.DOTALL):
        out += text[at : m.start()].replace("$", r"\$")
        name, number, other = m.groups()
        if name or number:
            key = name or number
            out += f"${{{key}}}" if not key.isdigit() else f"${int(key)}"
        else:
            out += {"n": "\n", "t": "\t", "r": "\r", "\\": r"\\"}.get(other, "\\\\" + other)
        at = m.end()
    return out + text[at:].replace("$", r"\$")


def java_pattern(pattern: str, literal: bool = False, ignore_case: bool = False) -> str:
    """A Python pattern as Java reads it: named groups, and Unicode classes."""
    if literal:
        pattern = re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", pattern)
    else:
        pattern = pattern.replace("(?P<", "(?<")
        pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
        pattern = pattern.replace(r"\Z", r"\z")
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def replaced(c: Column, pattern: str, replacement: str, literal: bool = False, ignore_case: bool = False, whole: bool = False) -> Column:
    """The cell with all matches replaced, or with ``whole`` only if the pattern matches all of it (untrimmed)."""
    c = cell(c)
    if literal and not ignore_case and not whole:
        return F.replace(c, F.lit(pattern), F.lit(replacement)) if pattern else c
    if literal:
        to = replacement.replace("\\", r"\\").replace("$", r"\$")
    else:
        to = java_replacement(replacement)
    body = java_pattern(pattern, literal, ignore_case)
    if whole:
        flags, rest = body[: body.index(")") + 1], body[body.index(")") + 1 :]
        return F.regexp_replace(c, rf"{flags}\A(?:{rest})\z", to)
    return F.regexp_replace(c, body, to)


TOKEN = 12


def hash_token(c: Column, salt: str, ignore_case: bool = False) -> Column:
    """The first 12 digits of HMAC-SHA-256 of the trimmed cell; a blank stays blank."""
    value = strip(cell(c))
    key = salt.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    body = F.encode(casefold(value) if ignore_case else value, "UTF-8")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)
    return F.when(value == "", F.lit("")).otherwise(F.substring(digest, 1, TOKEN))


def masked(c: Column, keep: int = 4) -> Column:
    """Stars for all but the last ``keep`` characters; a cell of no more than that is all stars."""
    value = strip(cell(c))
    size = F.length(value)
    tail = F.right(value, F.lit(keep)) if keep else F.lit("")
    return F.when(size <= keep, F.repeat(F.lit("*"), size)).otherwise(F.concat(F.repeat(F.lit("*"), size - keep), tail))


def email_token(c: Column, salt: str, ignore_case: bool = False) -> Column:
    """A token for what stands before the only @, and the domain in lower case; a token of all if it is no address."""
    value = strip(cell(c))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    is_address = value.rlike(r"\A[^@]+@[^@]+\z")
    return F.when(is_address, F.concat(hash_token(local, salt, ignore_case), F.lit("@"), F.lower(domain))).otherwise(hash_token(value, salt, ignore_case))


def merged(cells: list[Column], sep: str = " ", keep_blank: bool = False) -> Column:
    """Trimmed cells joined; blanks are left out, or kept unless all are blank."""
    if not keep_blank:
        return F.concat_ws(sep, *[filled(c) for c in cells])
    parts = [strip(cell(c)) for c in cells]
    return F.when(F.concat(*parts) == "", F.lit("")).otherwise(F.concat_ws(sep, *parts))


def parts(c: Column, n: int, sep: str | None = None, from_right: bool = False) -> Column:
    """An array of at most n trimmed parts of the trimmed cell; none of a blank one."""
    value = strip(cell(c))
    pattern = r"(?U)\s+" if sep is None else re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", sep)
    if not from_right:
        found = F.split(value, pattern, n)
    else:
        # cut everywhere, then put the front together again as it was
        pieces = F.split(value, pattern, -1)
        tail = F.slice(pieces, F.greatest(F.size(pieces) - (n - 2), F.lit(1)), F.lit(n - 1)) if n > 1 else F.array().cast("array<string>")
        if sep is None:
            head = F.regexp_replace(value, r"(?U)(\s+\S+){%d}\z" % (n - 1), "") if n > 1 else value
        else:
            head = F.substring_index(value, sep, 1) if n == 1 else F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - (n - 1), F.lit(0))), sep)
        head = value if n == 1 else head
        found = F.when(F.size(pieces) <= n, pieces).otherwise(F.concat(F.array(head), tail)) if n > 1 else F.array(value)
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.transform(found, strip))


def padded_parts(c: Column, n: int, sep: str | None = None, from_right: bool = False) -> list[Column]:
    """Exactly n columns of parts; what is missing is empty, at the left if split from the right."""
    found = parts(c, n, sep, from_right)
    shift = F.lit(n) - F.size(found) if from_right else F.lit(0)
    return [F.coalesce(F.when(F.lit(i) >= shift, F.get(found, F.lit(i) - shift)), F.lit("")) for i in range(n)]


RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10))]


def name_problem(c: Column) -> Column:
    """Why a name cannot be a file's name everywhere, or null."""
    stem = F.upper(F.rtrim(F.substring_index(c, ".", 1)))
    return (
        F.when(c.isNull() | c.isin("", ".", "..") | c.rlike(r"[/\\]"), F.lit("not a valid file name"))
        .when(c.rlike(r'[<>:"|?*\x00-\x1f]'), F.lit("contains characters Windows does not allow"))
        .when(c.rlike(r"[ .]\z"), F.lit("ends with a space or dot"))
        .when(stem.isin(RESERVED), F.lit("is a reserved device name on Windows"))
    )
