"""Substring dedup: repeated windows of words, by Rabin-Karp hashes counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import repeats, shared
from tabloom.llm.textcore import Words, chunks


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                n = len(offsets) - 1
                gone = repeats.coverage(batch.column(2).slice(at, n), words.bounds, size)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.bounds])
                # kept words and one space after each, but not after the last of a document
                starts, ends, docs = words.starts[~gone], words.ends[~gone], words.documents()[~gone]
                lengths = ends - starts
                to = np.cumsum(lengths + 1)
                text = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
                text[repeats.ranges(to - lengths - 1, lengths)] = data[repeats.ranges(starts, lengths)]
                total = np.bincount(docs, lengths + 1, n).astype(np.int64)
                keep = np.ones(len(text), bool)
                keep[np.cumsum(total)[total > 0] - 1] = False
                bounds = np.concatenate(([0], np.cumsum(np.maximum(total - 1, 0))))
                kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(text[keep].tobytes())).cast(pa.string())
                yield pa.record_batch(
                    [batch.column(0).slice(at, n), pa.array(words.counts), pa.array(removed), kept, repeats.span_lists(gone, words.bounds)],
                    ["doc_id", "n_words", "n_removed", "text", "removed"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 13) -> DataFrame:
    """Remove each word in a window of ``window`` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, text (kept words joined by one space) and
    removed (maximal intervals of word positions) for each document.  Windows are
    judged on the input.

    Every window's hash is computed where its key may repeat, and counted in Spark as
    128 bits with the least doc_id.  A unit of windows found again as a whole needs
    no counting: all of it is removed but in the document with the least id.

    Null and empty texts have no words; a null doc_id counts as larger than all ids;
    rows with the same doc_id remove nothing from each other; very long texts are
    read whole; an empty table gives no rows; other columns are not read.  ``gram``
    steers only the cost.
    """
    kind = repeats.WordSequences
    source = repeats.keyed(docs)
    units = repeats.candidates(source, kind, window, gram)
    contexts = shared.table(units.groupBy("key", "ctx").agg(F.min("d").alias("m")))
    seen = units.join(contexts, ["key", "ctx"])
    whole = seen.where("d > m").select("d", "th", "start", "n")
    several = shared.table(contexts.groupBy("key").count().where("count > 1").select("key"))
    wanted = seen.where("d = m").join(several, "key", "left_semi").select("d", "th", "start", "n")
    windows = shared.table(repeats.hashed_windows(source, wanted, kind, window))
    again = shared.table(windows.groupBy("h1", "h2").agg(F.min("d").alias("m"), F.max("d").alias("most")).where("m < most").select("h1", "h2", "m"))
    single = windows.join(again, ["h1", "h2"]).where("d > m").select("d", "th", "start", F.lit(1).cast("long").alias("n"))
    joined = repeats.marked(source, whole.union(single))
    return shared.mapped(joined.select("doc_id", "text", "runs"), _cut(window), "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>")
