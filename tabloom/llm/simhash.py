"""SimHash near-duplicates: exact pairs of fingerprints by vantage-point trees.

Fingerprints are first dealt by their Hamming distance from vantage points: a tree of
fixed depth, whose points and medians come from a bounded sample, names the shards, and
every fingerprint goes to each shard whose bound it meets within the radius, so that
pairs across a boundary meet.  As most distances between fingerprints are near the
middle, more levels would copy nearly as much as they divide; so a shard is divided
further by bits: two fingerprints that differ in at most three bits agree in one of
four blocks of any division of the bits.  The number of bits follows the number of
fingerprints, and a shard that is still crowded is divided by its other bits again.
Within a shard a vantage-point tree answers all queries at once: a branch is left out
where the triangle bound rules it out.  A shard gives the links that span its groups,
not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared
from tabloom.llm.textcore import Words, chunks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Levels of the vantage-point tree that deals fingerprints, the sample it is made from, and the points tried for a level.
LEVELS, SAMPLE, TRIED = 2, 4096, 16
#: Fingerprints of a shard that the number of bits aims at, and those above which a shard is divided again.
AIM, CROWDED = 1024, 4096


def fingerprint(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = Words(data, offsets)
    keep = np.zeros(len(data) + 1, bool)
    if len(words):
        inside = np.zeros(len(data) + 2, np.int8)
        inside[words.starts] += 1
        np.subtract.at(inside, words.ends, 1)
        keep = np.cumsum(inside[: len(data) + 1]) > 0
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1  # each word and a space
    starts = ends - lengths
    flat = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    space = np.zeros(len(flat), bool)
    space[ends] = True
    flat[~space] = _LOWER[data[keep[: len(data)]]]
    raw = flat.tobytes()
    counts = np.where(words.counts >= shingle, words.counts - shingle + 1, np.minimum(words.counts, 1))
    docs = np.repeat(np.arange(len(counts)), counts)
    first = words.bounds[:-1][docs] + np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + shingle, words.bounds[1:][docs]) - 1
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter([h64(raw[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())], np.uint64, len(first))
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        begin = (np.cumsum(counts) - counts)[full]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document as a signed 64-bit number."""

    return fingerprints_of(docs.select(F.lit(0).cast("long").alias("th"), "doc_id", "text"), shingle).select("doc_id", "fp")


def fingerprints_of(rows: DataFrame, shingle: int) -> DataFrame:
    """(th, doc_id, fp) of rows (th, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(2)):
                n = len(offsets) - 1
                yield pa.record_batch([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(fingerprint(data, offsets, shingle).view(np.int64))], ["th", "doc_id", "fp"])

    return shared.mapped(rows, run, "th long, doc_id long, fp long")


def vantage_pairs(index: np.ndarray, query: np.ndarray, radius: int, leaf: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in index, in query) of all pairs within the radius, a leaf of the vantage-point tree at a time."""
    stack = [(np.arange(len(index)), np.arange(len(query)))]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) * len(ask) > leaf and len(own) > 16:
            point = index[own[0]]
            near = np.bitwise_count(index[own] ^ point)
            far = np.bitwise_count(query[ask] ^ point).astype(np.int16)
            cut = int(np.median(near))
            inner = near <= cut
            if inner.all():
                inner = near < cut
            if inner.any():
                stack.append((own[inner], ask[far <= int(near[inner].max()) + radius]))
                stack.append((own[~inner], ask[far >= int(near[~inner].min()) - radius]))
                continue
        step = max(1, (1 << 20) // len(ask))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            i, j = np.nonzero(np.bitwise_count(index[part][:, None] ^ query[ask][None, :]) <= radius)
            yield part[i], ask[j]


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least node of each node's component under the links (a, b)."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _shard(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of sorted groups of values: (value, least linked value)."""
    unique, inverse = np.unique(values, return_inverse=True)
    label = np.arange(len(unique))
    cut = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(values))
    for first, last in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if last - first > 1:
            own = inverse[first:last]
            for i, j in vantage_pairs(unique[own], unique[own], radius):
                label = roots(len(unique), own[i], own[j], label)
    moved = np.flatnonzero(label != np.arange(len(unique)))
    return unique[moved], unique[label[moved]]


@dataclass
class Vantage:
    """A vantage-point tree of fixed depth: inner values are within ``cut`` of ``point``."""

    point: int
    cut: int
    inner: Vantage | None
    outer: Vantage | None


def vantage_tree(sample: np.ndarray, levels: int = LEVELS) -> Vantage | None:
    """The tree of a sample: of a few of its values the one whose distances spread the most is the point, their median the cut."""
    if not levels or not len(sample):
        return None
    tried = sample[: TRIED]
    point = tried[int(np.argmax(np.bitwise_count(tried[:, None] ^ sample[None, :]).std(axis=1)))]
    far = np.bitwise_count(sample ^ point)
    cut = int(np.median(far))
    return Vantage(int(point), cut, vantage_tree(sample[far <= cut], levels - 1), vantage_tree(sample[far > cut], levels - 1))


def _leaves(tree: Vantage | None, radius: int, met: Column) -> list[Column]:
    """For each leaf, whether the fingerprint is in it or within the radius of its bounds."""
    if tree is None:
        return [met]
    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(tree.point - (1 << 64) if tree.point >> 63 else tree.point)))
    return [*_leaves(tree.inner, radius, met & (far <= tree.cut + radius)), *_leaves(tree.outer, radius, met & (far > tree.cut - radius))]


def _without(value: str, at: Column, width: int) -> Column:
    """A number less the bits from ``at`` on."""
    shift = lambda name, x, n: F.call_function(name, x, n)
    high = shift("shiftrightunsigned", shift("shiftrightunsigned", F.col(value), at), F.lit(width))
    low = F.col(value).bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), at) - 1)
    return shift("shiftleft", high, at).bitwiseOR(low)


def shards(fps: DataFrame, radius: int = 3, aim: int = AIM, crowded: int = CROWDED) -> DataFrame:
    """(shard, fp) such that any two different fingerprints (column fp) within the radius share a shard."""
    if not 0 <= radius <= 3:
        raise ValueError("the four blocks find pairs of up to 3 differing bits")
    nodes = shared.table(fps.select("fp").distinct())
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    leaves = _leaves(vantage_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64)), radius, F.lit(True))
    held = nodes.select("fp", F.explode(F.array_compact(F.array(*[F.when(met, F.lit(i)) for i, met in enumerate(leaves)]))).alias("leaf"))
    bits = min(16, max(0, math.ceil(math.log2(max(1, nodes.count()) / aim))))
    k = F.explode(F.array(*map(F.lit, range(4 if bits else 1))))
    held = held.select("fp", "leaf", k.alias("k")).withColumn("at", F.col("k") * 16)
    part = F.call_function("shiftrightunsigned", F.col("fp"), F.col("at")).bitwiseAND(F.lit((1 << bits) - 1))
    held = held.select("fp", F.xxhash64("leaf", "k", part).alias("shard"), _without("fp", F.col("at"), 16).alias("rest"))
    for width in (12, 9, 6):  # four blocks of the 48, 36 and 27 bits that are left
        many = shared.table(held.groupBy("shard").count().where(F.col("count") > crowded).select("shard"))
        if many.isEmpty():
            break
        held = shared.table(held.join(shared.small(many.withColumn("many", F.lit(True))), "shard", "left"))
        split = held.where("many").select("fp", "shard", "rest", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).withColumn("at", F.col("k") * width)
        part = F.call_function("shiftrightunsigned", F.col("rest"), F.col("at")).bitwiseAND(F.lit((1 << width) - 1))
        split = split.select("fp", F.xxhash64("shard", "k", part).alias("shard"), _without("rest", F.col("at"), width).alias("rest"))
        held = held.where("many is null").select("fp", "shard", "rest").unionByName(split)
    return held.select("shard", "fp")


def links(fps: DataFrame, radius: int = 3, aim: int = AIM, crowded: int = CROWDED) -> DataFrame:
    """(a, b) links that span the same groups as all pairs of different fingerprints (column fp) within the radius.

    A task holds about 200,000 fingerprints, or those of one shard, at 16 bytes each.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, limit = 0, 200_000

        def solve(part: np.ndarray) -> pa.RecordBatch:
            a, b = _shard(np.ascontiguousarray(part[:, 1]).view(np.uint64), part[:, 0], radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            rows += batch.num_rows
            if rows >= limit:
                part = np.concatenate(held)
                last = int(np.searchsorted(part[:, 0], part[-1, 0], "left"))
                if last:
                    yield solve(part[:last])
                held = [part[last:]]
                rows = len(part) - last
                limit = max(200_000, 2 * rows)
        if rows:
            yield solve(np.concatenate(held))

    placed = shards(fps, radius, aim, crowded).repartition("shard").sortWithinPartitions("shard")
    return shared.mapped(placed.select("shard", "fp"), search, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints, and the least doc_id that links of up to ``radius`` bits reach.

    Null texts and texts without words have fingerprint zero and link like any other;
    a null doc_id is never a component's id unless no other is there; repeated rows are
    one group; very long texts are hashed whole; an empty table gives none; other columns
    are not read.
    """
    fps = shared.table(fingerprints(docs, shingle))
    return fps.join(named(fps, radius), "fp").select("doc_id", "fp", "component_id")


def rooted(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of a written table of fingerprints (doc_id, fp): the least doc_id of each fingerprint, and the least fingerprint that links reach."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = shared.components(links(nodes, radius))
    return nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def named(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of a written table of fingerprints (doc_id, fp)."""
    nodes = rooted(fps, radius)
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return shared.table(nodes.join(ids, "root").select("fp", "component_id"))


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs, all columns, with one document of each group: the least doc_id; of rows that share it, one.

    Groups are told apart by their fingerprints, not by their ids: documents with a
    null or a repeated id compete only with those that links join to them.  Null and
    empty texts are one group; very long texts are hashed whole; of rows that repeat id
    and text one stays; an empty table gives none; the other columns go along.
    """
    rows = shared.keyed(docs)
    fps = shared.table(rows.select("th", F.col("d").alias("doc_id"), F.col("row.text").alias("text")).transform(lambda x: fingerprints_of(x, shingle)))
    roots_of = shared.table(rooted(fps.select("doc_id", "fp"), radius).select("fp", "root"))
    # both written, so that a join of a large group can be split
    placed = shared.table(fps.join(roots_of, "fp").groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")))
    first = shared.table(placed.groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("first")))
    both = placed.join(first, "root")
    gone = shared.table(both.where("doc_id <> first.doc_id or th <> first.th").select(F.col("doc_id").alias("d"), "th"))
    left = shared.without(docs, gone)
    again = shared.table(first.where("first.n > 1").select(F.col("first.doc_id").alias("d"), F.col("first.th").alias("th")))
    # rows that repeat both id and text: rare, and only they are dealt out by a key
    columns = docs.columns
    more = shared.keyed(left).join(shared.small(again), ["d", "th"], "left_semi").dropDuplicates(["d", "th"]).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
    return shared.without(left, again).unionByName(more)
