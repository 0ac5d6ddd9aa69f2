"""Finding repeated windows of a sequence (words or bytes) without shuffling every window.

Each window has a key: the least Rabin-Karp hash of the short grams in it.  Equal
windows have equal keys, so a window whose key is found once is found once.  Windows
in a row that take their key from the same place form a unit, which is a hundredth
to a twentieth of the windows; units are what is shuffled, and only units with a
repeated key are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared
from tabloom.llm.shared import LAST
from tabloom.llm.textcore import U64, Words, chunks, prefix_hash, ranges, sliding_min, span_hash, window_hashes

UNIT = "d long, th long, start long, n long, off long, key long, ctx long"


class WordSequences:
    """Sequences of words."""

    most = 2_000_000

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets)
        self.values, self.bounds = self.words.hashes(), self.words.bounds


class ByteSequences:
    """Sequences of bytes."""

    most = 1_000_000

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.values, self.bounds = data.astype(np.uint64) + U64(1), offsets


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, th, text): d is the id with null as the largest, th tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def units_of(values: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, place of the key behind the start, key, hash of all the unit's values) of each unit."""
    width = size - gram + 1
    prefix = prefix_hash(values)
    grams = window_hashes(prefix, gram)
    n = max(0, len(values) - size + 1)
    at = sliding_min((grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), width)[:n] & U64(0xFFFFFFFF)
    at = at.astype(np.int64)
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = docs[:n] == docs[size - 1 : size - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (docs[1:n] != docs[: max(n - 1, 0)])
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.append((new | ~inside)[1:], True)) if n else first
    doc = docs[first]
    return doc, first - bounds[doc], last - first + 1, at[first] - first, grams[at[first]], span_hash(prefix, first, last + size)


def units(docs: DataFrame, kind: type, size: int, gram: int) -> DataFrame:
    """The units of all documents (from :func:`keyed`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, data, offsets in chunks(batch.column(2), kind.most):
                found = kind(data, offsets)
                doc, start, n, off, key, ctx = units_of(found.values, found.bounds, size, gram)
                yield pa.record_batch([pa.array(c) for c in (d[at + doc], th[at + doc], start, n, off, key.view(np.int64), ctx.view(np.int64))], [x.split()[0] for x in UNIT.split(", ")])

    return shared.mapped(docs.select("d", "th", "text"), run, UNIT)


def candidates(docs: DataFrame, kind: type, size: int, gram: int) -> DataFrame:
    """The units whose key is found more than once, as a written table.

    The repeated keys are written first: a join whose sides are both shuffles of
    their own can split a key that many units have.
    """
    found = units(docs, kind, size, gram)
    again = shared.table(found.groupBy("key").count().where("count > 1").select("key"))
    return shared.table(found.join(again, "key", "left_semi").select(*[x.split()[0] for x in UNIT.split(", ")]))


def hashed_windows(docs: DataFrame, wanted: DataFrame, kind: type, size: int) -> DataFrame:
    """(h1, h2, d, th, start): 128-bit hashes of the windows of wanted units (d, th, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            for at, data, offsets in chunks(batch.column(2), kind.most):
                found = kind(data, offsets)
                own = lists.slice(at, len(offsets) - 1)
                flat, doc = own.flatten(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                begin = ranges(found.bounds[doc] + start, n)
                doc = np.repeat(doc, n)
                h = [span_hash(prefix_hash(found.values, k), begin, begin + size, k).view(np.int64) for k in (0, 1)]
                yield pa.record_batch([pa.array(c) for c in (*h, d[at + doc], th[at + doc], begin - found.bounds[doc])], ["h1", "h2", "d", "th", "start"])

    runs = wanted.groupBy("d", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    joined = docs.select("d", "th", "text").join(runs, ["d", "th"])
    return shared.mapped(joined, run, "h1 long, h2 long, d long, th long, start long")


#: How often a unit is found from which on it is looked up without a shuffle of its rows, where a broadcast allows it.
CROWD = 256


def among(units: DataFrame, contexts: DataFrame) -> DataFrame:
    """The units whose key and ctx a written table (key, ctx, c) has more than once.

    Those that very many documents share are found first, by a join that shuffles
    nothing as long as they are few; beyond that, both sides of the join are shuffles
    that can be split.
    """
    crowded = shared.table(contexts.where(F.col("c") > CROWD).select("key", "ctx"))
    seen = units.join(shared.small(crowded.withColumn("crowd", F.lit(True))), ["key", "ctx"], "left")
    few = contexts.where((F.col("c") > 1) & (F.col("c") <= CROWD)).select("key", "ctx")
    return seen.where("crowd").drop("crowd").unionByName(seen.where("crowd is null").drop("crowd").join(few, ["key", "ctx"], "left_semi"))


def marked(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """docs with the column runs: the flagged windows (d, th, start, n) of each document as start, n; null if none."""
    runs = flagged.groupBy("d", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return docs.join(runs, ["d", "th"], "left")


def coverage(lists: pa.Array, bounds: np.ndarray, size: int) -> np.ndarray:
    """Which values of the documents lie in a flagged window."""
    flat, doc = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    step = np.zeros(int(bounds[-1]) + 1, np.int32)
    if len(flat):
        begin = bounds[doc] + flat.field(0).to_numpy()
        np.add.at(step, begin, 1)
        np.subtract.at(step, begin + flat.field(1).to_numpy() + size - 1, 1)
    return np.cumsum(step[:-1]) > 0


def spans(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal runs of flagged values, within each document."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[bounds] = True
    on = flags & (edge[:-1] | ~np.append(False, flags[:-1]))
    off = flags & (edge[1:] | ~np.append(flags[1:], False))
    begin, end = np.flatnonzero(on), np.flatnonzero(off) + 1
    doc = np.searchsorted(bounds, begin, "right") - 1
    return doc, begin - bounds[doc], end - bounds[doc]


def span_lists(flags: np.ndarray, bounds: np.ndarray) -> pa.Array:
    doc, begin, end = spans(flags, bounds)
    items = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(bounds))), pa.int32()), items)
