"""Quality rules: rule statistics of each text, and an isolation forest over them.

The forest isolates rows by random splits of the statistics; a row that is alone
after few splits is anomalous.  Each tree draws its rows from all labelled good rows
of one half, and the threshold on the anomaly score is calibrated on all labelled rows
of the other: it separates good from bad best while it keeps a stated share of the good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared
from tabloom.llm.textcore import U64, Words, chunks, mix, prefix_hash, range_hashes, span_hash, window_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_letters", "n_marks", "n_lines", "n_distinct", "n_bytes")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?,.;:\"'()[]{}-_=+/\\@^~`")] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS + EXTRA for each document, exact whole numbers."""
    words = Words(data, offsets)
    n, docs = len(offsets) - 1, words.documents()
    out = np.zeros((n, len(COUNTS) + len(EXTRA)), np.int64)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])

    out[:, 0] = words.counts
    out[:, 1] = per_doc(~_GAP_OR_TAIL[data])
    out[:, 2] = per_doc(_SYMBOL[data])
    out[:, 5], out[:, 6], out[:, 7] = per_doc(_UPPER[data]), per_doc(_LETTER[data]), per_doc(_MARK[data])
    out[:, 10] = np.diff(offsets)

    # lines: cut at \n and at the ends of documents
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    begin, end = cut[:-1], cut[1:]
    of = np.searchsorted(offsets, begin, "right") - 1
    end = end - (data[end - 1] == 10) if len(end) else end
    has = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, begin)
    begin, end, of = begin[has], end[has], of[has]
    out[:, 8] = np.bincount(of, minlength=n)
    prefix = prefix_hash(data.astype(np.uint64) + U64(1))
    line = mix(span_hash(prefix, begin, end) ^ mix(of.astype(np.uint64) + U64(1)))
    _, first = np.unique(line, return_index=True)
    out[:, 3] = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)

    hashes = words.hashes()
    own = mix(docs.astype(np.uint64) + U64(7))
    out[:, 9] = np.bincount(docs[np.unique(hashes ^ own, return_index=True)[1]], minlength=n)
    three = window_hashes(prefix_hash(hashes), 3)
    inside = docs[: len(three)] == docs[2 : 2 + len(three)]
    at = np.flatnonzero(inside)
    _, inverse, count = np.unique(three[at] ^ own[at], return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    mark = np.zeros(len(words) + 3, bool)
    for k in range(3):
        mark[again + k] = True
    out[:, 4] = np.bincount(docs[mark[: len(words)]], minlength=n)
    return out


#: Bytes that begin no code point of a word.
_GAP_OR_TAIL = np.zeros(256, bool)
_GAP_OR_TAIL[[9, 10, 11, 12, 13, 32]] = True
_GAP_OR_TAIL[128:192] = True


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest splits on: the rule statistics as ratios."""
    x = counts.astype(float)
    words, size = np.maximum(x[:, 0], 1), np.maximum(x[:, 10], 1)
    return np.column_stack([
        np.log1p(x[:, 0]), x[:, 1] / words, x[:, 2] / words, x[:, 3] / np.maximum(x[:, 8], 1), x[:, 4] / words,
        x[:, 5] / np.maximum(x[:, 6], 1), x[:, 6] / size, x[:, 7] / words, x[:, 9] / words ** 0.9,
    ])


@dataclass
class Forest:
    """Isolation trees as arrays: split feature (-1 in a leaf), split value, children, and the path length of leaves."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    mean: float
    depth: int
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): near 1 for rows that random splits isolate early."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, child, length in zip(self.feature, self.value, self.child, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                split = feature[node]
                right = x[rows, np.maximum(split, 0)] >= value[node]
                node = np.where(split < 0, node, child[node] + right)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.mean)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


#: Trees of a forest, rows that each is grown on, and steps of the score that a threshold can be.
TREES, SIZE, STEPS = 128, 1024, 1 << 16


def grow(x: np.ndarray, trees: int = TREES, size: int = SIZE, seed: int = 7) -> Forest:
    """An isolation forest of rows x; each tree is grown on ``size`` rows, to depth log2(size)."""
    random = np.random.default_rng(seed)
    size = min(size, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    most = 1 << (depth + 1)
    feature, value = np.full((trees, most), -1, np.int64), np.zeros((trees, most))
    child, length = np.zeros((trees, most), np.int64), np.zeros((trees, most))
    for t in range(trees):
        stack, used = [(0, x[random.choice(len(x), size, replace=False)] if len(x) else x, 0)], 1
        while stack:
            node, rows, level = stack.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(wide):
                length[t, node] = level + expected_path(len(rows))
                continue
            f = int(random.choice(wide))
            v = random.uniform(low[f], high[f])
            feature[t, node], value[t, node], child[t, node] = f, v, used
            right = rows[:, f] >= v
            stack += [(used, rows[~right], level + 1), (used + 1, rows[right], level + 1)]
            used += 2
    return Forest(feature, value, child, length, max(expected_path(size), 1e-9), depth)


def cut(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The level that rejects most bad rows and fewest good ones among those that keep the share ``keep`` of the good.

    good, bad: how many rows have each of the levels, which rise.
    """
    if not good.sum() or not bad.sum():
        return float("inf")
    kept, missed = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    return float(levels[int(np.argmax(np.where(kept >= keep, kept - missed, -np.inf)))])


def calibrate(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """:func:`cut` of the scores of good and of bad rows."""
    levels, at = np.unique(np.concatenate([good, bad]), return_inverse=True)
    return cut(levels, np.bincount(at[: len(good)], minlength=len(levels)), np.bincount(at[len(good) :], minlength=len(levels)), keep)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in chunks(batch.column(1)):
            x = statistics(data, offsets)
            yield pa.record_batch([batch.column(0).slice(at, len(x)), *(pa.array(c) for c in x.T)], ["doc_id", *COUNTS, *EXTRA])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of each document; a null text has no words."""
    return shared.mapped(docs.select("doc_id", "text"), _stats, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA)))


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Under 50 words, or over half of the words in repeated three-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def fit(docs: DataFrame, labels: DataFrame, keep: float = 0.995, seed: int = 7, share: float = 0.01) -> Forest:
    """:func:`fit_statistics` of the documents (doc_id, text) that have a label."""
    return fit_statistics(rule_statistics(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")), labels, keep, seed, share)


def fit_statistics(stats: DataFrame, labels: DataFrame, keep: float = 0.995, seed: int = 7, share: float = 0.01) -> Forest:
    """Fit on all labelled rows (doc_id, quality) of a table of :func:`rule_statistics`.

    Only rows that pass the base rules count, as the forest decides on no others: it is
    grown on one half, and its threshold is calibrated on all rows of the other half,
    where it keeps at least the share ``keep`` of the good; thresholds are multiples of
    1 / STEPS, so that rows are counted by score and only the counts are brought together.
    Each tree draws SIZE rows; where the half has more good rows than all trees draw, those
    with the least hashes are drawn.  Bad ones of ``share`` of their number are among them: with
    none, what no good row has would never be split on, and with many they would not be
    isolated early.  Null and empty texts fail the base rules; rows without an id or a
    label of 0 or 1 are not used; of rows that repeat an id the larger label and the least
    statistics hold; without good rows, or without bad ones to calibrate on, the forest
    rejects nothing; other columns are not read.
    """
    columns = [*COUNTS, *EXTRA]
    known = shared.table(labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")))
    rows = stats.join(shared.small(known), "doc_id").where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*columns)).alias("x")).select("quality", "x.*", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    rows = shared.table(rows)
    grown, other = rows.where("h & 1 = 0"), rows.where("h & 1 = 1")

    def here(df: DataFrame) -> np.ndarray:
        found = df.toPandas().sort_values(["h", *columns])
        return found[columns].to_numpy(np.int64).reshape(len(found), len(columns))

    n = grown.where("quality = 1").count()
    if not n:
        return grow(features(np.zeros((0, len(columns)))))
    good = here(grown.where("quality = 1").where(F.shiftrightunsigned("h", 1) < F.lit(min(1.0, TREES * SIZE / n) * 2.0**63)))
    bad = here(grown.where("quality = 0").orderBy("h", *columns).limit(max(1, round(share * len(good)))))
    forest = grow(features(np.concatenate([good, bad])), seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(features(np.column_stack([c.to_numpy() for c in batch.columns[1:]])))
            yield pa.record_batch([batch.column(0), pa.array(np.ceil(score * STEPS).astype(np.int64))], ["quality", "level"])

    scored = shared.mapped(other.select("quality", *columns), run, "quality int, level long")
    counts = scored.groupBy("level").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()
    level, good, bad = np.array(sorted(map(tuple, counts)), np.int64).reshape(-1, 3).T
    forest.threshold = cut(level / STEPS, good, bad, keep)
    return forest


def assess(docs: DataFrame, forest: Forest) -> DataFrame:
    """Statistics, anomaly score and verdict of each document (doc_id, text).

    base_failed: under 50 words, or over half of the words in repeated three-word
    windows.  kept: not base_failed, and the forest's score is at most its threshold.

    Null and empty texts have no words and fail; a null doc_id stays null; repeated
    rows give a row each; an empty table gives none; with no labelled good rows the
    forest rejects nothing; other columns are not read.
    """

    return shared.mapped(docs.select("doc_id", "text"), lambda batches: _verdicts(_stats(batches), forest), VERDICTS)


def judge(stats: DataFrame, forest: Forest) -> DataFrame:
    """:func:`assess` of a table of :func:`rule_statistics`."""
    return shared.mapped(stats.select("doc_id", *COUNTS, *EXTRA), lambda batches: _verdicts(batches, forest), VERDICTS)


VERDICTS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"


def _verdicts(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)])
        failed = base_failed(x)
        score = forest.score(features(x))
        kept = ~failed & ~(score > forest.threshold)
        yield pa.record_batch(
            [*batch.columns[: 1 + len(COUNTS)], pa.array(failed), pa.array(kept), pa.array(score)],
            ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"],
        )
