"""Substring dedup and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import substring_dedup, suffix_dedup
from tabloom.llm.repeats import LAST


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_words(rows, size):
    least = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            key = b" ".join(w[k : k + size])
            least[key] = min(least.get(key, LAST + 1), LAST if i is None else i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if least[b" ".join(w[k : k + size])] < (LAST if i is None else i):
                gone[k : k + size] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def brute_bytes(rows, size):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(hashlib.md5(b[k : k + size]).digest() for k in range(len(b) - size + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[hashlib.md5(b[k : k + size]).digest()] > 1:
                gone[k : k + size] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def same(a, b):
    return Counter(map(repr, a)) == Counter(map(repr, b))


@pytest.mark.parametrize("size, gram", [(50, 13), (8, 3)])
def test_words(docs, documents, size, gram):
    found = substring_dedup.substring_dedup(docs, size, gram).select("doc_id", "n_words", "n_removed", "text", "removed").collect()
    assert same([tuple(r)[:4] for r in found], brute_words(documents, size))
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


@pytest.mark.parametrize("length, gram, hot", [(400, 100, 256), (60, 16, 4), (24, 8, 2)])
def test_bytes(docs, documents, length, gram, hot):
    found = suffix_dedup.suffix_dedup(docs, length, gram, hot).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in found]
    assert same(got, brute_bytes(documents, length))


def test_periodic_bytes(spark):
    rows = [(1, "ab" * 700), (2, "x" * 900), (3, "x" * 450 + "y" + "x" * 450), (4, "ba" * 650 + "!")]
    for hot in (256, 0):
        found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in found]
        assert same(got, brute_bytes(rows, 400))


def test_crowded_key(spark):
    """One common passage amid different texts: more units of a key than a shard holds."""
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    common = word(60)
    rows = [(i, f"{word(50)} {common} {word(50)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.suffix_dedup(df, hot=8).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in found]
    assert same(got, brute_bytes(rows, 400))
    got = [tuple(r) for r in substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert same(got, brute_words(rows, 50))


def test_empty(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=200))
def test_suffix_array(values):
    s = np.array(values, np.int64)
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: values[i:])


def test_long_suffix_array():
    s = np.random.default_rng(0).integers(1, 3, 30_000)
    order = suffix_dedup.suffix_array(s)
    raw = s.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(s)), key=lambda i: raw[i:])
