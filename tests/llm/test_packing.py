"""Packing against the tokenizer on whole texts, and the layout of sequences."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm import packing, shared

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_and_layout(docs, documents):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in documents)
    rows = packing.pack(docs, PATH).collect()
    sequences = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(len(ids) for _, ids in want.elements())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) * 2048 - total <= 2048 * 5  # one short block for each of the input's partitions
    # rows that agree in doc_id are told apart by their ids
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for (doc, n), own in pieces.items():
        texts = [ids for (i, ids), c in want.items() if i == doc and len(ids) == n for _ in range(c)]
        starts = Counter()
        for start, ids in own:
            part = tuple(np.frombuffer(ids, "<u4"))
            starts[start] += 1
            assert any(t[start : start + len(part)] == part for t in texts)
        assert sum(len(ids) for _, ids in own) == 4 * n * len(texts)
    assert sum(r["length"] for r in rows) == total


def test_crc(spark):
    from tabloom.llm import queries

    rows = queries.op2_packing(spark, "/root/testdata/sf0.001").collect()
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])


@pytest.mark.parametrize("text", ["naïve café", "á b", "İstanbul 123's it'll", "x y", "a\u0085b", "漢字かな 🙂🙂", "ΣΑΣ ς", "<|endoftext|> x", "퟿​"])
def test_words_encode_as_whole_text(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ids, counts = packing.WordTokenizer(PATH).encode(data, np.array([0, len(data)]))
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert counts.tolist() == [len(ids)]


def test_memory_of_words():
    """60,000 different words, kept in a few parts of what they took as long numbers, with the ids of the whole text."""
    text = " ".join(f"{i:x}q{i % 9973}" for i in range(60_000))
    data = np.frombuffer(text.encode(), np.uint8)
    tokenizer = packing.WordTokenizer(PATH)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    for _ in range(2):  # new words, then known ones
        ids, counts = tokenizer.encode(data, np.array([0, len(data)]))
        assert ids.dtype == np.uint32 and ids.tolist() == want and counts.tolist() == [len(want)]
    assert tokenizer.words == 60_000
    held = sum(x.nbytes for x in vars(tokenizer).values() if isinstance(x, np.ndarray))
    assert held < 24 * 60_000 + 3 * len(want), held / 60_000


def test_freed_memory_goes_back():
    """What a task has freed below a block that is still in use is given back."""

    def resident() -> int:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    blocks = [bytes(2000) for _ in range(100_000)]
    last = blocks.pop()
    del blocks
    before = resident()
    shared.release()
    assert before - resident() > 100_000_000 and len(last) == 2000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=120))
def test_windows(sizes):
    windows = packing.windows_of(sizes, 512)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) <= 512
    assert max(sums) - min(sums) <= max(sizes)


def test_many_empty_texts():
    """300,000 empty texts in one partition: blocks are bounded by their pieces too, and little is padded."""
    pack = packing.packer(PATH, 2048, 256, 128 * 2048, 1, 1 << 16)
    rows = list(pack(iter([pa.record_batch([pa.array(range(10_000)), pa.nulls(10_000, pa.string())], ["doc_id", "text"])] * 30)))
    assert sum(b.num_rows for b in rows) == 300_000 and max(b.num_rows for b in rows) <= (1 << 16) + 10_000
    assert len({s for b in rows for s in b.column(4).to_pylist()}) <= 1.05 * 300_000 / 2048


def test_groups_of_pieces():
    assert packing.grouped([100, 100, 100, 256, 1, 1], 256) == [range(0, 2), range(2, 3), range(3, 4), range(4, 6)]
    assert packing.grouped([], 256) == []


def test_no_rows(empty):
    assert packing.pack(empty, PATH).count() == 0
