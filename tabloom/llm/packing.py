"""Packing: documents become token sequences of at most a fixed length with little padding.

A document's ids are cut at multiples of the sequence length; what is left over is
cut into short pieces, and the pieces of a block of documents are dealt to windows
by Karmarkar-Karp multiway differencing: the two partial partitions with the
largest imbalance are merged so that their imbalances oppose each other, until one
near-equal partition is left.  If its largest window exceeds the capacity, the
number of windows rises by one and the block is dealt again.

The work is one pass over each input partition without a shuffle: a block holds a
bounded number of tokens and of pieces, so memory does not grow with the input, and a
task that is run again makes the same sequences.  Short pieces in a row are dealt as one.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabloom.llm import shared
from tabloom.llm.textcore import Words, chunks, ranges

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins words over white space.

    Each different word is encoded once and kept (up to ``most`` words), at 16 bytes
    and its ids, which take two bytes each where the vocabulary allows; a text's ids are
    those of its words in order.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        #: The ids of all words, and where those of a slot begin; the next slot's begin where they end.
        self.pool, self.first = np.zeros(1 << 16, self.kind), np.zeros(1024, np.uint32)
        self.used = self.words = 0

    def _learn(self, keys: np.ndarray, words: list[str], step: int = 4096) -> None:
        """Encode new words, a few at a time, as the tokenizer gives much more than ids; keys are sorted."""
        slots = np.arange(self.words, self.words + len(keys), dtype=np.uint32)
        self.first = _room(self.first, self.words + len(keys) + 1)
        for at in range(0, len(words), step):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + step], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ends = self.used + np.cumsum(sizes)
            self.pool = _room(self.pool, int(ends[-1]))
            self.pool[self.used : ends[-1]] = np.fromiter((x for one in found for x in one), self.kind, int(sizes.sum()))
            self.first[self.words + 1 : self.words + 1 + len(found)] = ends
            self.used = int(ends[-1])
            self.words += len(found)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        words = Words(data, offsets)
        keys, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if self.words + len(keys) > self.most and self.words:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            new = at[~known]
            raw = data.tobytes()
            self._learn(keys[~known], [raw[a:b].decode() for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist())])
            place = np.searchsorted(self.keys, keys)
        slots = (self.slot[place].astype(np.int64) if len(keys) else place)[inverse]
        sizes = self.first[slots + 1].astype(np.int64) - self.first[slots]
        ids = self.pool[ranges(self.first[slots], sizes)].astype(np.uint32)
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(total[words.bounds])


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """The array, with a quarter more of zeros where it is shorter than size."""
    return held if size <= len(held) else np.concatenate([held, np.zeros(size + size // 4 - len(held), held.dtype)])


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway number partitioning: the items of each window."""
    zeros = np.zeros(windows, np.int64)
    heap, left, right = [], {}, {}
    for i, size in enumerate(sizes):
        sums, nodes = zeros.copy(), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    serial, fresh = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_nodes = heapq.heappop(heap)
        _, _, b_sums, b_nodes = heapq.heappop(heap)
        sums, b_nodes = a_sums + b_sums[::-1], b_nodes[::-1]
        nodes = np.maximum(a_nodes, b_nodes)
        both = np.flatnonzero((a_nodes >= 0) & (b_nodes >= 0))
        for w, x, y in zip(both.tolist(), a_nodes[both].tolist(), b_nodes[both].tolist()):
            left[fresh], right[fresh] = x, y
            nodes[w] = fresh
            fresh += 1
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[0]
        serial += 1
        heapq.heappush(heap, (-int(sums[-1]), serial, sums, nodes))
    out: list[list[int]] = []
    for root in heap[0][3].tolist() if heap else []:
        items, stack = [], [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x in left:
                stack += (right[x], left[x])
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: the fewest that differencing fills without excess."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in dealt):
            return [items for items in dealt if items]
        windows += 1


def grouped(sizes: list[int], most: int) -> list[range]:
    """Runs of pieces in a row with at most ``most`` ids together, or one piece."""
    out, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            out.append(range(first, i))
            first, total = i, 0
        total += size
    return [*out, range(first, len(sizes))] if sizes else out


def packer(path: str, length: int, piece: int, block: int, end_id: int, pieces: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of pieces not yet in a window
        held = 0

        def deal() -> list[tuple]:
            nonlocal sequence, waiting, held
            rows = []
            sizes = [len(x[2]) for x in waiting]
            groups = grouped(sizes, piece)
            for items in windows_of([sum(sizes[g.start : g.stop]) for g in groups], length) if waiting else []:
                offset = 0
                for i in (i for g in items for i in groups[g]):
                    doc, start, ids, total = waiting[i]
                    rows.append((doc, start, len(ids), total, sequence, offset, ids.tobytes()))
                    offset += len(ids)
                sequence += 1
            waiting, held = [], 0
            return rows

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, data, offsets in chunks(batch.column(1)):
                ids, counts = tokenizer.encode(data, offsets)
                rows, at = [], 0
                for doc, n in zip(doc_ids[first : first + len(counts)], counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id))
                    at += n
                    whole = len(own) // length * length
                    for start in range(0, whole, length):
                        rows.append((doc, start, length, len(own), sequence, 0, own[start : start + length].tobytes()))
                        sequence += 1
                    for start in range(whole, len(own), piece):
                        waiting.append((doc, start, own[start : start + piece], len(own)))
                    held += len(own) - whole
                    if held >= block or len(waiting) >= pieces:
                        rows += deal()
                if rows:
                    yield _batch(rows)
        if rows := deal():
            yield _batch(rows)

    return pack


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, piece: int = 256, windows: int = 128, end_id: int = 1, pieces: int = 1 << 16) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``length`` ids.

    Returns a row per piece: doc_id, start (the document's ids before it), length,
    doc_tokens (ids of the document, ``end_id`` included), sequence_id, offset in
    the sequence (gapless from 0) and ids (little-endian unsigned 32-bit).

    A null or empty text is the single id ``end_id``; a null doc_id stays null;
    repeated rows are packed once each; very long texts fill sequences of their
    own; an empty table gives no rows; other columns are not read.

    ``piece`` is the longest piece of a remainder, ``windows`` the windows of a
    block that are balanced together, and ``pieces`` the pieces that end a block of
    very short texts early: 32 sequences of one id each piece, so little is padded.
    """
    return shared.mapped(docs.select("doc_id", "text"), packer(tokenizer_path, length, piece, windows * length, end_id, pieces), SCHEMA)
