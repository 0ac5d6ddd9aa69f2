"""Fingerprints and groups against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import xxhash

from tabloom.llm import shared, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    return Counter((i, f, c) for i, f, c, _ in brute_roots(rows))


def brute_roots(rows):
    """(doc_id, fingerprint, component_id, number of the group) of each row."""
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    different = sorted({f for _, f in prints})
    a = np.array(different, np.uint64)
    label = list(range(len(a)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            label[root(int(j))] = root(i)
    least = {}
    for i, f in prints:
        if i is not None:
            r = root(different.index(f))
            least[r] = min(least.get(r, i), i)
    return [(i, f, least.get(root(different.index(f))), root(different.index(f))) for i, f in prints]


def test_groups(docs, documents):
    found = simhash.groups(docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found) == brute_groups(documents)


def test_dense_links(spark):
    """Chains, crowds in one block and rings: the same components as all pairs."""
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for c in centres:
        x = c
        for _ in range(250):
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) if rng.random() < 0.5 else 0
            values.add(x)
            values.add(c & ~0xFFFF | rng.getrandbits(16))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    index = {v: i for i, v in enumerate(sorted(values))}
    a = np.array(sorted(values), np.uint64)

    def components(pairs):
        label = np.arange(len(a))
        return simhash.roots(len(a), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), label)

    every = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3) if j > i]
    for aim, crowded in ((512, 4096), (16, 4096), (64, 40), (4096, 30)):
        links = [(index[r["a"] & (1 << 64) - 1], index[r["b"] & (1 << 64) - 1]) for r in simhash.links(df, aim=aim, crowded=crowded).collect()]
        assert (components(links) == components(every)).all()


def test_representatives(docs, documents):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter(c for c, _ in {(c, g) for _, _, c, g in brute_roots(documents)})


def test_representatives_without_ids(spark):
    """Documents that no link joins stay, whatever their ids: null ids, and an id that is the least of two groups."""
    a, b, c, d = ("alpha beta gamma delta " * 30, "one two three four five " * 30, "red green blue black white grey " * 30, "north east south west " * 30)
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, d), (None, c)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, a), (None, b), (7, c), (7, d)])


def test_no_rows(empty):
    assert simhash.groups(empty).count() == 0
    assert simhash.representatives(empty).count() == 0


def test_vantage_pairs():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)), a])
    found = {(int(i), int(j)) for x, y in simhash.vantage_pairs(a, b, 3, leaf=256) for i, j in zip(x, y)}
    assert found == {(i, int(j)) for i in range(400) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= 3)}


def test_tree_answers(spark):
    """On whole tables shards are large enough for the tree to branch, and bounded; every fingerprint has one."""
    fps = shared.table(simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    placed = shared.table(simhash.shards(fps))
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert max(sizes) <= simhash.CROWDED
    assert sum(n for n in sizes if n * n > 1 << 15) > 0.5 * sum(sizes)
    assert placed.select("fp").distinct().count() == fps.select("fp").distinct().count()


def test_vantage_tree():
    rng = np.random.default_rng(4)
    tree = simhash.vantage_tree(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    assert tree.inner is not None and tree.outer is not None and tree.inner.inner is None
    assert simhash.vantage_tree(np.zeros(0, np.uint64)) is None
