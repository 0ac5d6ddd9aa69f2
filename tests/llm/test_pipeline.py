"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
from test_line_dedup import brute as brute_lines
from test_line_dedup import shuffled
from test_simhash import brute_groups

from tabloom.llm import shared

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared.table(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
    before, after = seen["line_dedup"]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before.collect()])
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()) == Counter((i, t, len(t)) for i, t, *_ in want)
    before, after = seen["simhash_near_dedup"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in groups})
    before, after = seen["decontamination"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    assert np.mean([i in kept for i, t in labels.items() if t == 0]) > 0.9
    assert np.mean([i in kept for i, t in labels.items() if t == 1]) < 0.5


def test_edge_rows(spark, docs):
    """Null, empty and very long texts, ties, repeated rows, null ids and clashing columns go through all stages."""
    rows = shared.table(docs)
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, shared.table(stage(spark, rows, SF))
        ids = Counter(r["doc_id"] for r in rows.collect())
        had = Counter(r["doc_id"] for r in before.select("doc_id").collect())
        assert set(ids) <= set(had)
        if name == "packing":
            assert set(ids) == set(had) and rows.agg({"length": "min"}).first()[0] > 0
            continue
        assert rows.schema.simpleString() == before.schema.simpleString() and ids <= had
        assert ids == had if name == "line_dedup" else rows.exceptAll(before).count() == 0
        assert rows.where("th <> 'x'").count() == 0


def test_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, empty, SF)
        assert found.count() == 0 and (name == "packing" or found.columns == empty.columns)


def test_run_gives_rows(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:1] == ["doc_id"] and rows.count() > 0


def test_lines_with_many_keys(spark, monkeypatch):
    """In line_dedup, lines whose segments no other line has are not shuffled where the shared segments are too many to broadcast."""
    monkeypatch.setattr(shared, "SMALL", 0)
    random = np.random.default_rng(4)
    rows = [(i, "".join(random.choice(list("abcdefghij klmnopq"), 60))) for i in range(300)]
    rows += [(1000, rows[5][1] + "x"), (1001, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as the tables are small here
    try:
        found = corpus_pipeline.drop_lines(spark, df, SF).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(map(tuple, found)) == Counter((i, t) for i, t, *_ in brute_lines(rows))
    first, second = sorted((n for s, n in shuffled(spark).items() if s not in before), reverse=True)[:2]
    assert first > 3_000 and second < first / 3, (first, second)
