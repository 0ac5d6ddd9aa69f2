"""Rule statistics against brute force; the forest's verdicts on labelled rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    three = Counter(zip(words, words[1:], words[2:]))
    mark = [False] * len(words)
    for k in range(len(words) - 2):
        if three[tuple(words[k : k + 3])] > 1:
            mark[k : k + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(mark)


def test_statistics(docs, documents):
    forest = quality.grow(np.zeros((0, 9)))
    rows = quality.assess(docs, forest).collect()
    got = Counter((r["doc_id"], *[r[c] for c in quality.COUNTS], r["base_failed"]) for r in rows)
    want = Counter()
    for i, t in documents:
        n = brute(t)
        want[(i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert got == want
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_verdicts(spark):
    """Fitted on one half of the labels, judged on the other: what the forest itself rejects among rows that pass the base rules."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.assess(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 1000 and len(bad) > 100
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.25


def test_base_failed_rows_are_not_kept(spark):
    rows = queries.op5_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert any(r["base_failed"] for r in rows) and not any(r["kept"] for r in rows if r["base_failed"])


def test_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    forest = quality.grow(x)
    assert forest.score(np.full((1, 4), 9.0))[0] > np.quantile(forest.score(x), 0.99)
    assert quality.calibrate(np.array([0.1, 0.2, 0.3]), np.array([0.9]), 0.9) < 0.9


def test_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.assess(empty, quality.fit(empty, labels)).count() == 0


def test_all_labelled_rows(spark, monkeypatch):
    """Beyond 20,000 labels each labelled row is still drawn from or calibrated on, and the threshold keeps its share of all good ones."""
    rows = [(i, " ".join(f"w{(i * 7919 + k * (k + i % 89)) % 4001}" for k in range(55 + i % 17)) + ("!" * 400 if i % 250 == 0 else "")) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 250 > 0)) for i, _ in rows], "doc_id long, quality int")
    seen = {}
    grow = quality.grow
    monkeypatch.setattr(quality, "grow", lambda x, **how: seen.setdefault("grown", x) is None or grow(x, **how))
    forest = quality.fit(docs, labels)
    assert len(seen["grown"]) > 11_500
    x = quality.rule_statistics(docs).toPandas()
    half = x["doc_id"].isin([r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").where(F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit(1)) == 1).select("doc_id").collect()])
    assert half.sum() + len(seen["grown"]) == 24_000
    counts = x[half & (x["doc_id"] % 250 > 0)][[*quality.COUNTS, *quality.EXTRA]].to_numpy()
    assert np.mean(forest.score(quality.features(counts)) <= forest.threshold) >= 0.995
