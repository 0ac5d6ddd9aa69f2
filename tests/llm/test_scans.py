"""Decontamination and licence scans."""

from __future__ import annotations

import numpy as np
import pytest

from tabloom.llm import decontamination, licenses

ITEM = "Today Anna buys 12 apples for 3 dollars each at the small market near the old river bridge. How many dollars does Anna pay in total for all of the apples she buys there?"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM, "x"), (2, "a short item of the list", "y"), (None, ITEM, "z"), (3, None, "w"), (4, "The committee met on Tuesday to discuss the annual budget for road repairs in the northern district of the county", "v")]
    return spark.createDataFrame(rows, "item_id long, text string, d string")


def found(spark, bench, texts):
    docs = spark.createDataFrame([(i, t, "q", "r") for i, t in texts], "doc_id long, text string, d string, th string")
    return {r["doc_id"]: [(x["item_id"], x["n_windows"]) for x in r["items"]] for r in decontamination.decontaminate(docs, bench).collect()}


def test_reparameterised(spark, bench):
    other = ITEM.replace("12", "7").replace("3 dollars", "25 euros").replace("Anna", "Boris")
    mixed = ITEM.replace("12", "7", 1).replace("Anna pay", "Clara pay")
    got = found(spark, bench, [
        (10, f"Some words before. {ITEM} Some words behind."), (11, f"Intro text {other} end"), (12, f"Intro text {mixed} end"),
        (13, "Nothing of the kind is said in this text, which has more than eight words."), (14, None), (15, ""), (None, ITEM), (16, "w " * 50_000 + ITEM + " w" * 1000),
    ])
    assert set(got) == {10, 11, 12, None, 16}  # in 12 one name stands for two, and the windows without it are found
    assert all(items[0][0] == 1 for items in got.values())


def test_one_changed_slot(spark, bench):
    """A slot that conflicts takes its own windows away, not those beside it; slots that conflict all along are no match."""
    own = ITEM.replace("12", "7").replace("3 dollars", "25 euros").replace("Today Anna", "Today Boris").replace("Anna pay", "Clara pay")
    rows = [(1, f"Intro text {ITEM.replace('Anna pay', 'Clara pay')} end"), (2, f"Intro text {own} end")]
    names = "When Anna met Anna then Anna saw Anna and Anna heard Anna while Anna told Anna"
    each = iter("Bea Cleo Dora Emma Fred Gus Hugo Ida".split())
    items = bench.limit(0).unionByName(spark.createDataFrame([(1, ITEM, "x"), (5, names, "y")], bench.schema))
    got = found(spark, items, [*rows, (3, " ".join(next(each) if w == "Anna" else w for w in names.split()))])
    n = len(ITEM.split()) - 7
    assert got == {1: [(1, n - 2)], 2: [(1, n - 2)]}  # all but the two windows that hold the other name


def test_names_and_numbers_anywhere(spark, bench):
    """Names at the beginnings of sentences, capitals beyond ASCII, windows of many numbers; a table of other numbers is no match."""
    items = [
        (1, "Tom has 5 apples. Ann has 3 apples. How many apples do they have together?"),
        (2, "On Monday the baker Élodie sold some bread to Ángel and then Élodie paid all that she owed to Ángel"),
        (3, "Add 12 , 15 , 18 , 21 , 24 and 27 to 31 , 35 , 39 , 43 and 47 then subtract 5 , 6 and 7"),
        (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
    ]
    bench = bench.limit(0).unionByName(spark.createDataFrame([(i, t, "") for i, t in items], bench.schema))
    got = found(spark, bench, [
        (1, "Bob has 7 apples. Sue has 2 apples. How many apples do they have together?"),
        (2, "On Monday the baker Örjan sold some bread to Łukasz and then Örjan paid all that she owed to Łukasz"),
        (3, "Add 13 , 16 , 19 , 22 , 25 and 28 to 32 , 36 , 40 , 44 and 48 then subtract 8 , 9 and 10"),
        (4, "101 102 103 104 105 106 107 108 109 110 111 112 113 114 115 116 117 118 119 120"),
        (5, f"x {items[3][1]} y"), (6, items[0][1].lower()), (7, f"we saw {items[0][1]}"),
        (8, "Tom has 5 pears. Ann took 3 plums. How many of them do they share now?"),
    ])
    assert {d: [i for i, _ in x] for d, x in got.items()} == {1: [1], 2: [2], 3: [3], 5: [4], 6: [1], 7: [1]}
    assert got[1] == [(1, 8)]


def test_short_items(spark, bench):
    """Items under eight tokens are found by their whole length; those under three as whole texts."""
    items = bench.limit(0).unionByName(spark.createDataFrame([(1, "What is the capital of France?", ""), (2, "Why not", ""), (3, "What is 3 times 4 ?", ""), (4, "", "")], bench.schema))
    got = found(spark, items, [
        (1, "He asked: What is the capital of France? Nobody knew."), (2, "Tell me, what is the capital of Spain?"), (3, "Why not"), (4, "why not say so"),
        (5, "and what is 7 times 9 ? we asked"), (6, "What is the size of France?"), (7, ""), (8, None),
    ])
    assert {d: [i for i, _ in x] for d, x in got.items()} == {1: [1], 2: [1], 3: [2], 5: [3]}


def brute_items(texts, items, window=8, share=0.5, enough=6):
    """(doc_id, item_id) pairs by comparing every window of every item at every place of every text."""

    def tokens(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        token, value, literal, _, maybe = decontamination.templates(data, np.array([0, len(data)]))
        return [(int(t), int(v), int(x), bool(m)) for t, v, x, m in zip(token, value, literal, maybe)]

    def forms(part):
        """The window with words that begin sentences as words, and as names."""
        out = [[(t, v) for t, v, _, _ in part]]
        if any(m for *_, m in part):
            out.append([(int(decontamination.NAME), x | 1) if m else (t, v) for t, v, x, m in part])
        return out

    def fits(a, b):
        """The pairs of slots for which the windows are the same template, for each form of both."""
        for x in forms(a):
            for y in forms(b):
                if [t for t, _ in x] == [t for t, _ in y] and (sum(not v for _, v in x) >= min(2, len(x) + 1) or [w[2] for w in a] == [w[2] for w in b]):
                    yield frozenset((v, w) for (_, v), (_, w) in zip(x, y) if v)

    def best(found):
        """Windows by place: the most that are literal, or hold pairs one to one, the most frequent first."""
        literal = len({s for s, p in found if all(v == w for v, w in p)})
        times = {}
        for _, p in found:
            for pair in p:
                times[pair] = times.get(pair, 0) + 1
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        held = []
        for v, w in sorted(times, key=lambda x: (-times[x], signed(x[0]), signed(x[1]))):
            if all(v != a and w != b for a, b in held):
                held.append((v, w))
        return max(literal, len({s for s, p in found if p <= set(held)}))

    docs = [(i, tokens(t)) for i, t in texts]
    places = {}
    for d, (_, ts) in enumerate(docs):
        for k in range(len(ts)):
            places.setdefault(ts[k][2], []).append((d, k))
    out = set()
    for item, text in items:
        own = tokens(text)
        size = min(window, len(own))
        total = len(own) - size + 1
        for d, (i, ts) in enumerate(docs):
            if not own or len(ts) < size or not {t for _, _, t, _ in own} & {t for _, _, t, _ in ts}:
                continue
            by = {}
            for s in range(total):
                for k in range(len(ts) - size + 1):
                    if any(v == 0 and not m and t != ts[k + n][0] for n, (t, v, _, m) in enumerate(own[s : s + size])):
                        continue
                    for p in fits(own[s : s + size], ts[k : k + size]):
                        by.setdefault(k - s, set()).add((s, p))
            need = min(enough, -(-total * share // 1))
            if any(best(found) >= need for found in by.values()) and (len(own) >= 3 or len(ts) == len(own)):
                out.add((i, item))
    return out


def test_decontamination_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], x["item_id"]) for r in decontamination.decontaminate(docs, items).collect() for x in r["items"]}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    some = [t for t in texts if len(t[1] or "") < 3000]
    want = brute_items(some, [(r["item_id"], r["text"]) for r in items.collect()])
    assert {x for x in got if x[0] in {i for i, _ in some}} == want and want


def test_code_points():
    text = "Aé€𝄞ßΩ"
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.flatnonzero(data & 0xC0 != 0x80)
    point, size = decontamination.points(data, at)
    assert point.tolist() == [ord(c) for c in text] and size.tolist() == [len(c.encode()) for c in text]


def test_half_of_an_item(spark, bench):
    words = ITEM.split()
    got = found(spark, bench, [(1, " ".join(words[:20])), (2, " ".join(words[:9])), (3, "The committee met on Tuesday to discuss the annual budget for road repairs")])
    assert 1 in got and 2 not in got and got.get(3, [(4,)])[0][0] == 4


def test_without(spark, bench):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "clean text", "b"), (None, ITEM, "c"), (1, "clean too", "d")], "doc_id long, text string, row string")
    left = decontamination.without(docs, decontamination.decontaminate(docs, bench))
    assert left.columns == docs.columns
    assert sorted(r["row"] for r in left.collect()) == ["b", "d"]


def test_no_rows(spark, empty, bench):
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), bench.limit(0)).count() == 0


def brute_scan(text, rules=licenses.RULES, gap=3):
    """Licences by sequences of known sentences, by plain search."""
    scanner = licenses.Scanner(rules, gap)
    known = scanner.sentences(text or "")
    hits = []
    for name, ids in scanner.rules:
        for i in range(len(known)):
            at, last = i, None
            for want in ids:
                nxt = next((j for j in range(at, len(known)) if known[j][1] == want and (last is None or known[j][0] - known[last][0] <= gap)), None) if last is not None else (i if known[i][1] == want else None)
                if nxt is None:
                    break
                last, at = nxt, nxt + 1
            else:
                hits.append(name)
    return set(hits)


def test_rules(spark):
    mit = dict(licenses.RULES[3:4]) and ". ".join(licenses.RULES[3][1]) + "."
    texts = [
        (1, f"Header line\n\n{mit}\nBody"), (2, "Nothing"), (3, None), (4, ""), (5, "RELEASED   under the mit licence? Released under the MIT License. More text."),
        (6, "Licensed under CC BY-SA 4.0"), (None, "All rights reserved."), (7, "x " * 40_000 + "\nLicensed under CC BY 4.0.\n" + "y " * 40_000),
    ]
    df = spark.createDataFrame([(i, t, "e") for i, t in texts], "doc_id long, text string, hits string")
    got = {r["doc_id"]: set(r["licenses"]) for r in licenses.scan(df).collect()}
    assert got == {1: {"MIT"}, 2: set(), 3: set(), 4: set(), 5: {"MIT"}, 6: {"CC-BY-SA-4.0"}, None: {"all-rights-reserved"}, 7: {"CC-BY-4.0"}}


def test_scan_against_plain_search(spark, docs, documents):
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(set(r["licenses"]))
    for i, t in documents:
        assert any(found <= brute_scan(t) for found in got[i])
        assert bool(brute_scan(t)) == any(got[i])


def test_wrapped_and_embedded(spark):
    """Known sentences over two lines, after or before other words, and further licences."""
    texts = [
        (1, "Some title\nThis project is licensed under\nthe MIT License\nand more text on the next line"),
        (2, "(c) 2020 Foo, Licensed under CC BY 4.0"),
        (3, "(c) 2020 Foo, Licensed under CC BY-NC-SA 4.0 by the author"),
        (4, "(c) Foo, Licensed under CC BY-NC 4.0"),
        (5, "This work is licensed under the GNU Lesser General Public License, version 2.1"),
        (6, " ".join(s + "." for s in dict(licenses.RULES)["GPL-2.0-or-later"])),
        (7, "İ (c) Foo, Licensed under CC BY 4.0"),
        (8, "The text says unlicensed under CC BY 4.05 and that is all"),
    ]
    got = {r["doc_id"]: (r["licenses"], r["hits"]) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: ["MIT"], 2: ["CC-BY-4.0"], 3: ["CC-BY-NC-SA-4.0"], 4: ["CC-BY-NC-4.0"], 5: ["LGPL-2.1"], 6: ["GPL-2.0-or-later"], 7: ["CC-BY-4.0"], 8: [],
    }
    assert [texts[k - 1][1][h["start"] : h["end"]] for k in (2, 7) for h in got[k][1]] == ["Licensed under CC BY 4.0"] * 2


def test_short_rests_among_words():
    assert licenses.Scanner().sentences("We use version 2.0 of the licensed software") == []


def test_no_documents(empty):
    assert licenses.scan(empty).count() == 0
