"""Suffix-array dedup: repeated byte strings, by the difference-cover algorithm on shards.

Not one suffix array of the whole corpus: triples are sorted, named and merged within
a shard, as a sort of every suffix of the corpus in Spark, and again for each level of
names, would move the text many times over.  Which links come from what is stated here.
Links between different units come from adjacent suffixes of a shard's array.  Links
between units that are equal as a whole, and between windows of crowded keys in blocks
of one place, come from two 64-bit Rabin-Karp hashes.

The text is split among tasks by content: windows that share a key (see
``repeats``) are in one shard, so that equal strings always meet.  Each shard's
suffix array is built by the difference cover modulo 3: the suffixes at sampled
positions are sorted by triples, names of triples are sorted by recursion, the other
suffixes are merged in, and adjacent suffixes are compared over the window's length.

A key with more different units than a shard may hold does not go to one task: its
units are cut by where the key stands in a window, first into blocks of 64 places,
then of 8 and of 1.  What the windows of a block have in common is the new key, so
that only windows which agree in more and more of their bytes stay together; with
blocks of one place they agree in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import repeats, shared
from tabloom.llm.textcore import U64, chunks, lanes, mix, prefix_hash, ranges, span_hash


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of s (numbers from 1 to 2**21 - 1) in order; a suffix goes before those that it begins."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.uint64), np.zeros(3, np.uint64)])
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3, n // 3
    extra = n0 - n1  # with n % 3 == 1, a sampled suffix of zeros stands behind the last
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    # sort sampled triples
    triple = (s[sample] << U64(42)) | (s[sample + 1] << U64(21)) | s[sample + 2]
    order = np.argsort(triple)
    new = np.append(True, triple[order][1:] != triple[order][:-1])
    name = np.cumsum(new)
    if name[-1] < len(sample):
        # recurse on names: suffixes at 1 mod 3, then those at 2 mod 3
        names = np.empty(len(sample), np.int64)
        names[order] = name
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    sample = sample[order]
    sample = sample[sample < n]
    # the remaining suffixes, by first value and the sampled suffix behind it
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((s[rest] << U64(32)) | rank[rest + 1])]
    # merge
    is_one = sample % 3 == 1
    first, second = sample[is_one], sample[~is_one]
    key1 = lambda i: (s[i] << U64(32)) | rank[i + 1]
    key2 = lambda i: (s[i] << U64(43)) | (s[i + 1] << U64(22)) | rank[i + 2]
    rest1, rest2, first1, second2 = key1(rest), key2(rest), key1(first), key2(second)
    out = np.empty(n, np.int64)
    out[np.arange(len(rest)) + np.searchsorted(first1, rest1) + np.searchsorted(second2, rest2)] = rest
    behind = np.empty(len(sample), np.int64)
    behind[is_one], behind[~is_one] = np.searchsorted(rest1, first1), np.searchsorted(rest2, second2)
    out[np.arange(len(sample)) + behind] = sample
    return out


def repeated(data: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Which positions start a string of ``size`` bytes that starts elsewhere too; strings lie within bounds."""
    n = len(data)
    lengths = np.diff(bounds)
    values = np.zeros(n + len(lengths), np.int64)
    place = np.arange(n) + np.repeat(np.arange(len(lengths)), lengths)
    values[place] = data.astype(np.int64) + 2
    values[np.append(place[1:] - 1, len(values) - 1)[np.cumsum(lengths) - 1]] = 1
    order = suffix_array(values)
    back = np.full(len(values), -1, np.int64)
    back[place] = np.arange(n)
    room = np.repeat(bounds[1:], lengths) - np.arange(n) >= size
    at = back[order]
    at = at[at >= 0]
    at = at[room[at]]
    a, b = at[:-1], at[1:]
    view = lanes(data)
    for step in range(0, size, 8):
        step = min(step, size - 8)
        same = view[a + step] == view[b + step]
        a, b = a[same], b[same]
    out = np.zeros(n, bool)
    out[a] = out[b] = True
    return out


PIECE = "key long, ctx long, d long, th long, start long, off long, text binary"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]
BLOCKS = (64, 8, 1)


def _binary(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(length)))
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch holds more than 2 GB of units")
    return pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[ranges(begin, length)].tobytes())])


def _units_text(size: int):
    """The text of each unit that a document's runs name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th, lists = batch.column(0), batch.column(1), batch.column(3)
            for at, data, offsets in chunks(batch.column(2), 1_000_000):
                own = lists.slice(at, len(offsets) - 1)
                flat, doc = own.flatten(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                row = pa.array(at + doc)
                text = _binary(data, offsets[doc] + start, n + size - 1)
                yield pa.record_batch([flat.field("key"), flat.field("ctx"), d.take(row), th.take(row), pa.array(start), flat.field("off"), text, flat.field("hot")], [*_NAMES, "hot"])

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _split(size: int, block: int, most: int = 2_000_000):
    """Units cut where the key's place in the window passes a multiple of ``block``.

    Blocks of one place are whole windows, which key and ctx name by 128 bits, so they
    have no text.  Rows are taken so few at a time that their pieces stay within
    ``most`` bytes, as a unit has no more than ``size`` windows.
    """
    at_once = max(1, most // ((size // block + 2) * (size + block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                rows = batch.slice(first, at_once)
                data, bounds = _bytes_of(rows.column(6))
                off, start = rows.column(5).to_numpy(), rows.column(4).to_numpy()
                n = np.diff(bounds) - size + 1
                # window j of a unit has its key at off - j
                high, low = off // block, (off - n + 1) // block
                parts = high - low + 1
                unit = np.repeat(np.arange(len(n)), parts)
                b = high[unit] - (np.arange(len(unit)) - np.repeat(np.cumsum(parts) - parts, parts))
                begin = np.maximum(off[unit] - ((b + 1) * block - 1), 0)
                end = np.minimum(off[unit] - b * block, n[unit] - 1) + 1
                place = bounds[unit] + off[unit]  # of the key
                prefix = prefix_hash(data.astype(np.uint64) + U64(1))
                common = span_hash(prefix, place - b * block, place - ((b + 1) * block - 1) + size)
                key = mix(rows.column(0).to_numpy().view(np.uint64)[unit] * U64(31) + b.astype(np.uint64)) ^ common
                ctx = span_hash(prefix_hash(data.astype(np.uint64) + U64(1), 1), bounds[unit] + begin, bounds[unit] + end + size - 1, 1)
                at = pa.array(unit)
                text = _binary(data, bounds[unit] + begin, end - begin + size - 1) if block > 1 else pa.array([b""] * len(unit), pa.binary())
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), rows.column(2).take(at), rows.column(3).take(at), pa.array(start[unit] + begin), pa.array(off[unit] - begin), text], _NAMES)

    return run


def _shards(size: int, most: int = 1_500_000):
    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        data, bounds = _bytes_of(rows.column("text").chunk(0))
        row, begin, end = repeats.spans(repeated(data, bounds, size), bounds)
        start = rows.column("start").to_numpy()
        return pa.record_batch([rows.column("d").chunk(0).take(pa.array(row)), rows.column("th").chunk(0).take(pa.array(row)), pa.array(start[row] + begin), pa.array(end - begin)], ["d", "th", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        volume = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                volume += len(_bytes_of(part.column(4))[0])
                if volume >= most:
                    rows = pa.Table.from_batches(held)
                    keys = rows.column("key").to_numpy()
                    last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                    if last:
                        yield solve(rows.slice(0, last))
                        rest = rows.slice(last).combine_chunks()
                        held = rest.to_batches()
                        volume = sum(len(_bytes_of(x.column(4))[0]) for x in held)
        if held and sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1), 4_000_000):
                n = len(offsets) - 1
                gone = repeats.coverage(batch.column(2).slice(at, n), offsets, size)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
                bounds = np.concatenate(([0], np.cumsum(np.diff(offsets) - removed)))
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
                yield pa.record_batch(
                    [batch.column(0).slice(at, n), pa.array(np.diff(offsets)), pa.array(removed), kept, repeats.span_lists(gone, offsets)],
                    ["doc_id", "n_bytes", "n_removed", "kept", "removed"],
                )

    return run


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 100, hot: int = 256) -> DataFrame:
    """Remove each byte in a string of ``length`` bytes that also starts anywhere else, in the same document or another.

    Returns doc_id, n_bytes, n_removed, kept (the remaining bytes) and removed
    (maximal removed intervals of byte positions) for each document.  Strings are
    judged on the input, overlaps count, and no string crosses documents.

    Null and empty texts have no bytes; a null doc_id stays null; repeated rows are
    each other's copies; very long texts are read whole; an empty table gives no
    rows; other columns are not read.  ``gram`` steers only the cost; ``hot`` is the
    number of different units of one key above which they are cut into blocks.
    """
    kind = repeats.ByteSequences
    source = repeats.keyed(docs)
    units = repeats.candidates(source, kind, length, gram)
    contexts = shared.table(units.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "th", "start", "n", "off")).alias("at")))
    whole = repeats.among(units, contexts.select("key", "ctx", "c")).select("d", "th", "start", "n")
    several = shared.table(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    wanted = contexts.select("key", "ctx", "at.*").join(several, "key").withColumn("hot", F.col("k") > hot)
    runs = wanted.groupBy("d", "th").agg(F.collect_set(F.struct("start", "n", "key", "ctx", "off", "hot")).alias("runs"))
    # documents that agree in id and text have the same units; each is taken once
    texts = source.select("d", "th", "text").join(runs, ["d", "th"])
    texts = shared.table(shared.mapped(texts, _units_text(length), f"{PIECE}, hot boolean"))
    flagged = whole.union(_sorted(texts.where("not hot"), length))
    crowded = texts.where("hot").drop("hot").dropDuplicates(["key", "ctx"])
    for block in [b for b in BLOCKS if b < length]:
        if crowded.isEmpty():
            break
        pieces = shared.table(shared.mapped(crowded, _split(length, block), PIECE))
        contexts = shared.table(pieces.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c")))
        same = repeats.among(pieces, contexts)
        n = F.length("text") - length + 1 if block > 1 else F.lit(1)
        flagged = flagged.union(same.select("d", "th", "start", n.cast("long").alias("n")))
        if block == 1:
            break
        several = shared.table(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        rest = shared.table(pieces.dropDuplicates(["key", "ctx"]).join(several, "key").select(*_NAMES, (F.col("k") > hot).alias("hot")))
        flagged = flagged.union(_sorted(rest.where("not hot"), length))
        crowded = rest.where("hot").drop("hot")
    joined = repeats.marked(source, flagged)
    return shared.mapped(joined.select("doc_id", "text", "runs"), _cut(length), "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>")


def _sorted(rows: DataFrame, length: int) -> DataFrame:
    """The repeated windows (d, th, start, n) of units, by suffix arrays of shards."""
    rows = rows.select("key", "d", "th", "start", "text").repartition("key").sortWithinPartitions("key", "d", "th", "start")
    return shared.mapped(rows, _shards(length), "d long, th long, start long, n long")
