"""Toxicity on held-out labels, and the risk that it minimises."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import queries, toxicity


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n1 = label.sum()
    return (rank[label].sum() - n1 * (n1 + 1) / 2) / (n1 * (~label).sum())


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]] == 1) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    score, label = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert auc(score, label) > 0.95
    assert (score[~label] >= 0.3).mean() < 0.03 and (score[label] >= 0.3).mean() > 0.85


def test_non_negative_risk():
    """Unlabelled rows that hold positives are told apart all the same."""
    rng = np.random.default_rng(0)
    make = lambda n, p: rng.random((n, 30)) < p
    hot, cold = np.r_[np.full(10, 0.6), np.full(20, 0.2)], np.full(30, 0.2)
    positive = make(400, hot)
    unlabelled = np.vstack([make(300, hot), make(1200, cold)])
    w, b = toxicity.nnpu(positive, unlabelled, 0.2)
    score = unlabelled @ w + b
    label = np.r_[np.ones(300, bool), np.zeros(1200, bool)]
    assert auc(score, label) > 0.9


def test_rows(spark, empty, docs, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(empty, labels)
    assert toxicity.score(empty, model).count() == 0
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(documents) and all(r["score"] < 0.3 for r in scored)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(documents)


def test_fitted_on_repeated_ids(spark, docs):
    """An id that many rows repeat counts as one text, the least; a fitted model scores null, empty and long texts."""
    words = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, "vile ").otherwise("kind "), F.lit("word "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = words.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    some = words.where(~toxicity.held_out()).where("doc_id % 4 = 0").first()
    again = spark.range(3000).select(F.lit(some["doc_id"]).alias("doc_id"), F.concat(F.lit("z kind "), F.col("id").cast("string")).alias("text"))
    once, often = toxicity.fit(words, labels), toxicity.fit(words.unionByName(again), labels.unionByName(labels))
    assert len(once.words) and (once.words == often.words).all() and np.allclose(once.weights, often.weights)
    scored = toxicity.score(docs, often).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    ends = toxicity.score(words, often).join(words, "doc_id").groupBy(F.col("text").startswith("vile").alias("vile")).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    ends = {r["vile"]: r for r in ends.collect()}
    assert ends[True]["low"] > ends[False]["high"]
