"""Line dedup against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from llm_rows import rows_of
from pyspark.sql import functions as F

from tabloom.llm import line_dedup, shared

LAST = (1 << 63) - 1
BLANK = " \t\n\x0b\x0c\r"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within(a: str, b: str, k: int) -> bool:
    if abs(len(a) - len(b)) > k or sum((Counter(a) - Counter(b)).values()) > k:
        return False
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    row = {0: 0} | {j: j for j in range(1, min(k, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            new[j] = min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (j == 0 or x != b[j - 1])) if j else i
        row = new
    return row.get(len(b), 99) <= k


def brute(rows, threshold=2, shortest=20):
    """Kept text and removed line numbers of (doc_id, text) rows whose (doc_id, text) differ."""
    places = {}
    split = [(t or "").split("\n") for _, t in rows]
    for (i, _), parts in zip(rows, split):
        for pos, line in enumerate(parts):
            if line.strip(BLANK):
                places.setdefault(line, []).append((LAST if i is None else i, pos))
    lines = sorted((x for x in places if len(x) >= shortest), key=len)
    up = {x: x for x in places}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            if len(b) - len(a) > threshold:
                break
            if within(a, b, threshold):
                up[root(a)] = root(b)
    first = {}
    for x, at in places.items():
        first[root(x)] = min(first.get(root(x), (LAST + 1, 0)), min(at))
    out = []
    for (i, t), parts in zip(rows, split):
        gone = [p for p, x in enumerate(parts) if x.strip(BLANK) and (LAST if i is None else i, p) != first[root(x)]]
        out.append((i, None if t is None and not gone else "\n".join(x for p, x in enumerate(parts) if p not in gone), len(parts), gone))
    return out


def check(found, rows, **how):
    got = Counter(repr((r["doc_id"], r["text"], r["n_lines"], list(r["removed"]))) for r in found)
    assert got == Counter(map(repr, brute(rows, **how)))


def near_copies(n=160, seed=3):
    """A crowd of lines with one or two edits each, lines of other lengths, multi-byte letters, ties."""
    rng = random.Random(seed)
    base = "the quick brown fox jumps over the lazy dog and runs away"
    rows = []
    for i in range(n):
        line = list(base if i % 3 else "über den großen Fluß führt eine schöne alte Brücke")
        for _ in range(i % 4):
            at = rng.randrange(len(line))
            rng.choice([lambda: line.insert(at, rng.choice("xyzé")), lambda: line.pop(at), lambda: line.__setitem__(at, rng.choice("qwé"))])()
        rows.append((i, "".join(line) + "\nshort one\n\nshort two"))
    return rows


def test_against_brute_force(spark, docs, documents):
    rows = list(dict.fromkeys(documents))
    frame = docs.dropDuplicates(["doc_id", "text"])
    check(line_dedup.line_dedup(frame).collect(), rows)


def test_blank_lines_stay(spark):
    rows = [(1, " \t\n\t\n\nx\n\t\r\nx"), (2, "\t\n\t\n\x0b\nx")]
    check(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_crowds(spark, threshold):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(line_dedup.line_dedup(df, threshold).collect(), rows, threshold=threshold)


def test_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(600):
        a = [rng.choice("abcé") for _ in range(rng.randint(3, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            if rng.random() < 0.4 or not b:
                b.insert(at, rng.choice("abx"))
            elif rng.random() < 0.5:
                b.pop(min(at, len(b) - 1))
            else:
                b[min(at, len(b) - 1)] = rng.choice("abx")
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        for r in df.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            assert r["d"] == min(distance(r["a"], r["b"]), k + 1), r


def test_rows_and_columns(spark, empty):
    assert line_dedup.line_dedup(empty).count() == 0
    rows = [(1, "a line that is long enough", "x", 1), (1, "a line that is long enough", "x", 1), (2, "a line that is long enough\nb", "y", 2), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    found = line_dedup.without_repeated_lines(df)
    assert found.columns == df.columns
    assert Counter(map(tuple, found.collect())) == Counter([(1, rows[0][1], "x", 26), (1, rows[0][1], "x", 26), (2, "b", "y", 1), (None, None, None, None)])


def test_no_python(spark):
    """The main path has no Python."""
    plan = line_dedup.line_dedup(spark.createDataFrame([(r[0], r[1]) for r in rows_of("documents")][:20], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def shuffled(spark):
    """Rows that each stage so far wrote to a shuffle, by the stage's number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_many_keys(spark, monkeypatch):
    """Where the keys that lines share are too many to broadcast, lines without one of them are not shuffled, and classes are the same."""
    monkeypatch.setattr(shared, "SMALL", 0)
    rng = random.Random(11)
    rows = near_copies(12) + [(1000 + i, "".join(rng.choices("abcdefghij klmnopq", k=60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as the tables are small here
    try:
        check(line_dedup.line_dedup(df).collect(), rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first, second = sorted((n for s, n in shuffled(spark).items() if s not in before), reverse=True)[:2]
    assert first > 3_000 and second < first / 3, (first, second)  # the count of all keys is the one large shuffle


def test_sieve(spark, monkeypatch):
    """All rows of the keys pass and few others, whether the keys are broadcast or not."""
    keys = shared.table(spark.range(0, 600_000, 3).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("part")))
    rows = spark.range(0, 600_000).select("id", F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("part"))
    assert shared.sifted(rows, keys, ["key", "part"]).count() == 200_000
    monkeypatch.setattr(shared, "SMALL", 0)
    found = shared.sifted(rows, keys, ["key", "part"])
    assert found.columns == rows.columns and found.where("id % 3 = 0").count() == 200_000 and found.where("id % 3 > 0").count() < 4_000
