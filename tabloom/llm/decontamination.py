"""Benchmark decontamination: template windows, joined by hash, with a check of slots.

Numbers, names and units become typed placeholders, so that a question with other
numbers or names has the same template; a word with a capital that begins a sentence
is taken both as a word and as a name.  Windows of the template are hashed on both
sides and joined in Spark; a filter of fixed size, made from the benchmark's windows,
passes those that can match.  Windows that match at one alignment are put together,
and what fills the slots must map one to one between item and document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared
from tabloom.llm.shared import LAST
from tabloom.llm.textcore import U64, Words, chunks, mix, prefix_hash, range_hashes, window_hashes

NUMBER, NAME, UNIT = U64(0x1111111111111111), U64(0x2222222222222222), U64(0x3333333333333333)
UNITS = (
    "kg g mg km m cm mm mi mile miles inch inches foot feet yard yards l ml liter liters litre litres gallon gallons pound pounds lb lbs oz ounce ounces "
    "ton tons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent "
    "meter meters metre metres degree degrees kmh mph hz khz mhz ghz kb mb gb tb watt watts volt volts"
).split()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CORE = np.zeros(256, bool)  # bytes of letters and digits
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
#: By code point; the last stands for bytes that are no UTF-8.
_UPPER = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x110000)] + [False])
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n")] = True
FILTER_BITS = 24


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    lengths = np.array([len(u) for u in UNITS])
    return np.sort(range_hashes(data, np.cumsum(lengths) - lengths, lengths))


_UNIT_HASHES = _unit_hashes()


def points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, its number of bytes) of the UTF-8 characters that begin at these places."""
    lead = data[at].astype(np.int64)
    size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
    point = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in range(1, 4):
        more = size > k
        point = np.where(more, point << 6 | data[np.minimum(at + k, len(data) - 1)] & 0x3F, point)
    return np.minimum(point, 0x110000), size


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template token, value or 0 where it is no slot, literal token, first token of each text and the end, word with a capital that begins a sentence and so may be a name or not)."""
    words = Words(data, offsets)
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(4):  # marks at the ends of words; a word of marks keeps one
        trim = (ends - starts > 1) & ~_CORE[data[starts]] if len(starts) else np.zeros(0, bool)
        starts[trim] += 1
        trim = (ends - starts > 1) & ~_CORE[data[ends - 1]] if len(starts) else np.zeros(0, bool)
        ends[trim] -= 1
    h = range_hashes(_LOWER[data], starts, ends - starts)
    n = len(h)
    if not n:
        return h, h, h, words.bounds, np.zeros(0, bool)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    letters = np.concatenate(([0], np.cumsum(_CORE[data] & ~_DIGIT[data])))
    n_digits, n_letters = digits[ends] - digits[starts], letters[ends] - letters[starts]
    number = (n_digits > 0) & (n_letters == 0)
    mixed = _DIGIT[data[starts]] & (n_digits > 0) & (n_letters > 0) & (n_letters <= 3)  # 5kg
    begins = np.zeros(n + 1, bool)
    begins[words.bounds] = True
    begins = begins[:n]
    after_stop = begins | np.append(True, _STOP[data[words.ends[:-1] - 1]])
    first, wide = points(data, starts)
    longer = ends - starts > wide
    second, _ = points(data, np.where(longer, starts + wide, starts))
    capital = _UPPER[first] & longer & ~_UPPER[second]
    name, maybe = capital & ~after_stop, capital & after_stop
    at = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == h) & np.append(False, number[:-1]) & ~begins
    token = h.copy()
    token[number] = NUMBER
    token[mixed] = mix(np.array([NUMBER ^ UNIT]))[0]
    token[name] = NAME
    token[unit] = UNIT
    slot = number | mixed | name | unit
    return token, np.where(slot, h | U64(1), U64(0)), h, words.bounds, maybe & ~slot


def windows(found: tuple[np.ndarray, ...], size: int, passes: np.ndarray | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, hash, slot values of each window) of :func:`templates`: all windows, or those that a filter passes; of: the texts that are taken.

    A text shorter than a window has none.  A window with words that begin a sentence
    with a capital is given twice: with them as words, and as names.  A window with
    fewer than two tokens that are no slots is no template, so its values are hashed too.
    """
    token, value, literal, bounds, maybe = found
    n = len(token)
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = docs[: max(n - size + 1, 0)] == docs[size - 1 :]
    full = np.flatnonzero(inside if of is None else inside & of[docs[: len(inside)]])
    exact = mix(window_hashes(prefix_hash(literal), size)[full])
    begins = np.concatenate(([0], np.cumsum(maybe)))
    twice = begins[full + size] > begins[full]
    parts = []
    for tokens, slot_values, chosen in ((token, value, np.ones(len(full), bool)), (np.where(maybe, NAME, token), np.where(maybe, literal | U64(1), value), twice)):
        start = full[chosen]
        h = window_hashes(prefix_hash(tokens), size)[start]
        slots = np.concatenate(([0], np.cumsum(slot_values != 0)))
        bare = size - (slots[start + size] - slots[start]) < 2
        h[bare] ^= exact[chosen][bare]
        if passes is not None:
            at = h >> U64(64 - FILTER_BITS)
            hit = (passes[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
            h, start = h[hit], start[hit]
        parts.append((start, h, slot_values[start[:, None] + np.arange(size)] if len(start) else np.zeros((0, size), np.uint64)))
    start, h, values = (np.concatenate(x) for x in zip(*parts))
    return docs[start] if n else start, start - (bounds[docs[start]] if n else 0), h, values


#: Items with fewer tokens than this are found only as whole texts.
WHOLE = 3


def _emit(size: int, passes: np.ndarray | None, shorter: list[int]):
    """Windows of ``size`` tokens, and of the shorter sizes: of an item its whole text, of a document those that the filter passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, data, offsets in chunks(batch.column(2)):
                found = templates(data, offsets)
                n_tokens = np.diff(found[3])
                for n in (*shorter, size):
                    of = None if n == size or passes is not None and n >= WHOLE else n_tokens == n
                    doc, start, h, values = windows(found, n, passes, of)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * n, pa.int32()), pa.array(values.view(np.int64).ravel()))
                    yield pa.record_batch([pa.array(a[at + doc]), pa.array(b[at + doc]), pa.array(start), pa.array(h.view(np.int64)), lists, pa.array(n_tokens[doc])], ["a", "b", "start", "h", "slots", "n_tokens"])

    return run


_ROWS = "a long, b long, start long, h long, slots array<long>, n_tokens long"


def _starts(found: Column) -> Column:
    return F.size(F.array_distinct(F.transform(found, lambda w: w["start"]))).cast("long")


def _literal(found: str) -> Column:
    """How many windows of an alignment (start, pairs of slots and own) are equal word for word."""
    return _starts(F.filter(found, lambda w: F.forall(w["pairs"], lambda p: p["slots"] == p["own"])))


def _consistent(found: str) -> Column:
    """How many windows of an alignment hold only pairs of slots that map one to one.

    Of pairs that conflict, the one in most windows holds, and of equals the least.
    """
    clash = lambda kept, p: F.exists(kept, lambda q: (q["slots"] == p["slots"]) | (q["own"] == p["own"]))
    holds = lambda kept, p: F.exists(kept, lambda q: (q["slots"] == -p["slots"]) & (q["own"] == -p["own"]))
    ranked = lambda every: F.transform(F.array_distinct(every), lambda p: F.struct(F.size(F.filter(every, lambda q: q == p)).alias("n"), (-p["slots"]).alias("slots"), (-p["own"]).alias("own")))
    # an array of one element binds a value, so that it is found once
    pairs = F.transform(F.array(F.flatten(F.transform(found, lambda w: w["pairs"]))), ranked)[0]
    # from the most to the least: a pair holds unless one before it that holds has one of its sides
    return F.aggregate(
        F.reverse(F.array_sort(pairs)), F.array().cast("array<struct<n:int,slots:bigint,own:bigint>>"), lambda kept, p: F.when(clash(kept, p), kept).otherwise(F.array_append(kept, p)),
        lambda kept: _starts(F.filter(found, lambda w: F.forall(w["pairs"], lambda p: holds(kept, p)))),
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.5, enough: int = 6) -> DataFrame:
    """(doc_id, th, item_id, n_windows): items whose passages documents hold.

    An item is found if, at one alignment, the lesser of ``enough`` windows and
    ``share`` of its windows match and are equal word for word, or have slots that map
    one to one; windows with slots that conflict do not count, the others do.  An item
    of fewer tokens than ``window`` has one window, its whole length; one of fewer than
    three tokens, which any text may hold by chance, is found as a whole text alone.
    """
    text = F.coalesce("text", F.lit(""))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))
    item_windows = shared.table(shared.mapped(items, _emit(window, None, list(range(1, window))), _ROWS))
    shorter = sorted(r["n_tokens"] for r in item_windows.where(F.col("n_tokens") < window).select("n_tokens").distinct().collect())
    # 2 ** 24 bits at any size of the benchmark: at most 262,144 numbers come to the driver
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    filled = item_windows.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).collect()
    passes = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in filled:
        passes[row["at"]] = row["bits"] & ((1 << 64) - 1)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))
    found = shared.mapped(source, _emit(window, passes, shorter), _ROWS).select(F.col("a").alias("d"), F.col("b").alias("th"), "h", F.col("start").alias("at"), F.col("slots").alias("own"))
    wanted = item_windows.select("h", F.col("a").alias("item_id"), F.col("b").alias("item_th"), "start", "slots", "n_tokens")
    joined = found.join(wanted, "h").withColumn("shift", F.col("at") - F.col("start"))
    pairs = F.array_distinct(F.filter(F.arrays_zip("slots", "own"), lambda x: x["slots"] != 0))
    window_pairs = F.collect_set(F.struct("start", pairs.alias("pairs")))
    by = joined.groupBy("d", "th", "item_id", "item_th", "shift").agg(window_pairs.alias("found"), F.max("n_tokens").alias("n_tokens"))
    n = F.greatest(_literal("found"), _consistent("found"))
    need = F.least(F.lit(enough), F.ceil(F.greatest(F.col("n_tokens") - window + 1, F.lit(1)) * share))
    by = by.withColumn("n", n).where(F.col("n") >= need)
    return by.groupBy("d", "th", "item_id").agg(F.max("n").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.5, enough: int = 6) -> DataFrame:
    """doc_id, th (a hash of the text) and items of each contaminated document: (item_id, n_windows), by item_id.

    Null and empty texts hold nothing and are no items; a null doc_id is given as null; a null item_id is not looked for;
    repeated rows of a document are one row, those of an item count once; very long
    texts are read whole; empty tables give no rows; other columns are not read.
    """
    found = matches(docs, benchmark, window, share, enough)
    lists = found.groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("item_id", "n_windows"))).alias("items"))
    return lists.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "th", "items")


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, all columns, less the documents that :func:`decontaminate` gave."""
    return shared.without(docs, shared.table(found.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "th")))
