"""Toxicity: a linear classifier by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all other sampled texts are unlabelled and hold
toxic ones too, at the class prior.  The risk of the negatives is what the unlabelled
texts show less the prior's share of the positives; where that estimate falls below
zero, the step raises it again instead of fitting it further (non-negative
correction).  Features are the words of a text and how words begin; those whose share
in positives is beyond chance are chosen from counts over the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared
from tabloom.llm.textcore import U64, Words, chunks, mix, range_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>*#$%&|_-=+/\\@^~`")] = True


#: Bytes of the beginnings of words that are features, and how often a text has them.
BEGINNINGS, TIMES = (5, 6), (1, 2, 3)


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash), each once, in the documents' order.

    Features are the words, lower-cased and without marks at the ends, and how longer
    words begin: once, twice or more in the text, so that a family of words counts in
    texts where each of its words is rare.
    """
    words = Words(data, offsets)
    starts, ends, docs = words.starts.copy(), words.ends.copy(), words.documents()
    for _ in range(3):
        trim = (ends - starts > 1) & _EDGE[data[starts]] if len(starts) else np.zeros(0, bool)
        starts[trim] += 1
        trim = (ends - starts > 1) & _EDGE[data[ends - 1]] if len(starts) else np.zeros(0, bool)
        ends[trim] -= 1
    lower = _LOWER[data]

    def different(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, times = np.unique(h ^ mix(d.astype(np.uint64) + U64(3)), return_index=True, return_counts=True)
        return first, times

    h = range_hashes(lower, starts, ends - starts)
    first, _ = different(h, docs)
    found = [(docs[first], h[first])]
    for size in BEGINNINGS:
        long = np.flatnonzero(ends - starts > size)
        h, d = range_hashes(lower, starts[long], np.full(len(long), size), seed=size), docs[long]
        first, times = different(h, d)
        found += [(d[first[times >= n]], mix(h[first[times >= n]] ^ U64(n * 7919))) for n in TIMES]
    d, h = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


@dataclass
class Model:
    """Sorted hashes of the chosen words, their weights, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.intercept)
        if len(self.words):
            docs, h = features_of(data, offsets)
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            total += np.bincount(docs[hit], self.weights[at[hit]], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.05, decay: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative PU risk with the logistic loss (Adam)."""
    random = np.random.default_rng(seed)
    size = positive.shape[1]
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    steps = max(1, len(unlabelled) // batch)
    t = 0
    for _ in range(epochs):
        pu = np.array_split(random.permutation(len(unlabelled)), steps)
        for part in pu:
            p = positive[random.integers(0, len(positive), min(len(positive), batch // 2))].astype(float)
            u = unlabelled[part].astype(float)
            sp, su = 1 / (1 + np.exp(-(p @ w[:-1] + w[-1]))), 1 / (1 + np.exp(-(u @ w[:-1] + w[-1])))
            loss_u, loss_p = -np.log(1 - su + 1e-12).mean(), -np.log(1 - sp + 1e-12).mean()
            grad = lambda x, r: np.append(x.T @ r, r.sum()) / len(x)
            negative = grad(u, su) - prior * grad(p, sp)
            if loss_u - prior * loss_p >= 0:
                step = prior * grad(p, sp - 1) + negative
            else:
                step = -negative
            step[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000, vocabulary: int = 1024, beyond: float = 5.0, seed: int = 5) -> Model:
    """Train on bounded samples, the least by a hash of doc_id: ``positives`` texts with toxic = 1
    outside the held-out fold, and ``unlabelled`` other texts.

    The prior is the share of toxic = 1 among the labelled rows outside the fold.
    Features are chosen among those in at least 0.5 % of the positives, and two of them,
    if their shares among positives and unlabelled texts are ``beyond`` standard errors
    apart; the ``vocabulary`` that are farthest apart are kept.

    Null and empty texts are texts without words; very long ones are read whole; rows
    without an id or a label of 0 or 1 are not learned from; of rows that repeat an id
    one label, the larger, and one text, the least, hold; with an empty table, or no positive, the model has no
    words; other columns are not read.
    """
    known = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if not share:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    prior = min(max(float(share), 1e-3), 0.5)
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    sampled = known.where("toxic = 1").orderBy(*order).limit(positives).select("doc_id", F.lit(1).alias("positive"))
    rest = docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct().orderBy(*order).limit(unlabelled + positives)
    rest = rest.join(F.broadcast(sampled), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("positive"))
    chosen = F.broadcast(sampled.unionByName(rest))
    # an id that very many rows repeat gives one row, folded before it is shuffled
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("positive").alias("positive"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1)):
                d, h = features_of(data, offsets)
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(at, n), batch.column(2).slice(at, n), lists], ["doc_id", "positive", "words"])

    found = shared.mapped(rows, words, "doc_id long, positive int, words array<long>")
    counts = found.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    sizes = {r["positive"]: r["count"] for r in found.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    share_p, share_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    apart = F.abs(share_p - share_u) / F.sqrt(pooled * F.greatest(1 - pooled, F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    best = counts.where(F.col("p") >= max(2, 0.005 * n_p)).withColumn("apart", apart).where(F.col("apart") >= beyond).orderBy(F.desc("apart"), "word").limit(vocabulary)
    picked = np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))
    if not len(picked):
        return Model(picked, np.zeros(0), float(np.log(prior / (1 - prior))))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1)):
                d, h = features_of(data, offsets)
                n = len(offsets) - 1
                x = np.zeros((n, len(picked)), bool)
                where = np.minimum(np.searchsorted(picked, h), len(picked) - 1)
                hit = picked[where] == h
                x[d[hit], where[hit]] = True
                yield pa.record_batch([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["doc_id", "positive", "bits"])

    table = shared.mapped(rows, bits, "doc_id long, positive int, bits binary").toPandas().sort_values(["doc_id", "bits"])
    x = np.unpackbits(np.frombuffer(b"".join(table["bits"]), np.uint8).reshape(len(table), -1), axis=1)[:, : len(picked)]
    is_p = table["positive"].to_numpy() == 1
    # the unlabelled set stands for all texts: positives of the sample are part of it at the prior's share
    w, b = nnpu(x[is_p], x[~is_p], prior, seed=seed)
    return Model(picked, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each document (doc_id, text).

    Null and empty texts score as a text without any word; a null doc_id stays null;
    repeated rows give a row each; an empty table gives none; without positive labels
    all scores are near 0; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(offsets) - 1), pa.array(model.score(data, offsets))], ["doc_id", "score"])

    return shared.mapped(docs.select("doc_id", "text"), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that score under the threshold.

    Null, empty and very long texts are scored as :func:`score` does; repeated rows
    stay or go together; an empty table gives none.
    """
    columns = docs.columns
    at_text = columns.index("text")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(0).field(at_text)):
                keep = pa.array(model.score(data, offsets) < threshold)
                yield pa.record_batch([batch.column(0).slice(at, len(offsets) - 1).filter(keep)], ["row"])

    kept = shared.mapped(inner, run, inner.select("row").schema)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
