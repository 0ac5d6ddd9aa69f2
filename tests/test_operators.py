"""Operators on small tables: cases, errors, and the same result however the rows are dealt out."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators import aggregates, cells, checks, chunks, dedup, files, fill, filters, joins, lines, projection, records, reshape, sampling, sorting
from tabloom.plans import ordered
from tabloom.plans.names import NameProblem
from tabloom.plans.result import Refused


def frame(spark, header, rows, parts=3):
    """Text columns and _ord, dealt out to some tasks."""
    names = header.split()
    kind = "_ord long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kind).repartition(parts, "_ord")


def shown(df, by=None):
    rows = df.orderBy(by) if by else df
    return [tuple(r) for r in rows.drop("_ord").collect()]


SALES = [("A", "east", "10"), ("", "", "5"), (" ", "", ""), ("B", "", "7"), ("", "west", "")]


@pytest.mark.parametrize("parts", [1, 4])
def test_fill(spark, parts):
    df = frame(spark, "region store sales", SALES, parts)
    assert shown(fill.fill(df, "region,store").df, "_ord") == [("A", "east", "10"), ("A", "east", "5"), ("A", "east", ""), ("B", "east", "7"), ("B", "west", "")]
    assert shown(fill.fill(df, "region", up=True).df.select("_ord", "region"), "_ord") == [("A",), ("B",), ("B",), ("B",), ("",)]
    found = fill.fill(df, "region,store", within="region")
    assert shown(found.df, "_ord") == [("A", "east", "10"), ("A", "east", "5"), ("A", "east", ""), ("B", "", "7"), ("B", "west", "")]
    assert found.count("filled") == 5
    found = fill.fill(df, "sales", value="0")
    assert shown(found.df.select("_ord", "sales"), "_ord") == [("10",), ("5",), ("0",), ("7",), ("0",)] and found.count("filled") == 2


def test_order_over_buckets(spark):
    """Running values and numbers, with more rows than a bucket holds."""
    rows = [(str(i % 17 or ""), str(i // 300)) for i in range(6000)]
    df = frame(spark, "v g", [(v if i % 5 else "", g) for i, (v, g) in enumerate(rows)], 7)
    want, last, group = [], "", None
    for i, (v, g) in enumerate(rows):
        v = v if i % 5 else ""
        last = "" if g != group else last
        group, last = g, v or last
        want.append((last,))
    assert shown(fill.fill(df, "v", within="g").df.select("_ord", "v"), "_ord") == want
    numbered = ordered.numbered(df.where("_ord % 3 = 0"), ["_ord"], "no").orderBy("_ord").collect()
    assert [r["no"] for r in numbered] == list(range(2000))
    parts = chunks.by_rows(df, 700).groupBy("part").count().orderBy("part").collect()
    assert [tuple(r) for r in parts] == [(i, 700 if i < 9 else 400) for i in range(1, 10)]


def filled(rows, within, up):
    """Rows (v, g, w) filled by hand: v and w within g, which is filled itself, or each alone."""
    out, last, group, state = [], {}, "", None
    for v, g, w in reversed(rows) if up else rows:
        group = g if g.strip() else group
        if within and group.strip() != state:
            last, state = {}, group.strip()
        for name, cell in (("v", v), ("w", w)) if within else (("v", v), ("g", g), ("w", w)):
            if cell.strip():
                last[name] = cell
        out.append((last.get("v", v), (group if group.strip() else g) if within else last.get("g", g), last.get("w", w)))
    return out[::-1] if up else out


@pytest.mark.parametrize("up", [False, True])
@pytest.mark.parametrize("within", [None, "g"])
@pytest.mark.parametrize("seed", [1, 2])
def test_fills_against_brute_force(spark, monkeypatch, within, up, seed):
    """Runs that end in a bucket, that go on over several, and buckets without a filled cell."""
    monkeypatch.setattr(ordered, "ROWS", 20)
    import random

    rng = random.Random(seed)
    rows, group = [], ""
    while len(rows) < 700:
        group = rng.choice(["a", "b", " b", "c", "", " "])
        for _ in range(rng.choice([1, 2, 5, 30, 90])):
            rows.append((rng.choice(["x", "y", "z"]) if rng.random() < 0.1 else "", group if rng.random() < 0.2 else rng.choice(["", " "]), rng.choice(["1", " 2"]) if rng.random() < 0.02 else " "))
    df = frame(spark, "v g w", rows, 5)
    assert len(ordered.bucketed(df, ["_ord"]).select(ordered.BUCKET).distinct().collect()) > 25
    got = shown(fill.fill(df, within=within, up=up).df.select("_ord", "v", "g", "w"), "_ord")
    assert got == filled(rows, within, up)


def test_buckets_follow_the_order(spark, monkeypatch):
    """By two columns with ties and nulls, a timestamp, and an order that is the same for all."""
    monkeypatch.setattr(ordered, "ROWS", 30)
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 40).alias("a"), F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 997 % 1000).alias("t"), "id", F.lit(1).alias("one"))
    for order in (["a", "t"], ["t"], ["a"], ["one"]):
        rows = ordered.bucketed(df, order).select(ordered.BUCKET, F.struct(*order).alias("k"))
        ends = rows.groupBy(ordered.BUCKET).agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy(ordered.BUCKET)
        later = ends.select("high", F.lead("low").over(Window.orderBy(ordered.BUCKET)).alias("next"))
        assert later.where("not high < next").count() == 0
        assert ends.count() > 5 or order == ["one"]
    assert [r["no"] for r in ordered.numbered(df, ["a", "t"], "no").orderBy("a", "t").collect()] == list(range(1000))


PEOPLE = [("1", "NL", "10.50", "a@x.com"), ("2", "de", "n/a", ""), ("3", "NL", "7", "b@x.org"), ("4", "", "", "c@x.com"), ("5", "BE", "1_0.5", "d")]


def test_filters(spark):
    df = frame(spark, "id country amount email", PEOPLE)
    ids = lambda *a, **k: [r["id"] for r in filters.where(df, *a, **k).orderBy("_ord").collect()]
    assert ids("amount = 10.5") == ["1", "5"] and ids("amount != 10.5") == ["2", "3", "4"] and ids("amount > 5") == ["1", "3", "5"]
    assert ids("country = DE", ignore_case=True) == ["2"] and ids("country = DE") == []
    assert ids("email ~ \\.com$") == ["1", "4"] and ids("email !~ @") == ["2", "5"]
    assert ids(["country = NL", "amount > 8"]) == ["1"] and ids(["country = BE", "amount = 7"], any_match=True) == ["3", "5"]
    assert ids("country = ") == ["4"]
    with pytest.raises(NameProblem):
        ids("city = x")


def test_sort(spark):
    df = frame(spark, "name n", [("b", "10"), ("A", "9"), ("", ""), ("c", "9"), ("a", "-1")])
    go = lambda *a, **k: [r[0] for r in shown(sorting.sort(df, *a, **k).select("name"))]
    assert go("n") == ["a", "A", "c", "b", ""] and go("n:desc") == ["b", "A", "c", "a", ""] and go("name") == ["A", "a", "b", "c", ""]
    assert go("n:desc,name:desc") == ["b", "c", "A", "a", ""] and go("name", reverse=True) == ["c", "b", "A", "a", ""]
    assert shown(sorting.head(df, 2).select("name")) == [("b",), ("A",)]


def test_join(spark):
    left = frame(spark, "order cust amount", [("1", " a ", "5"), ("2", "b", "6"), ("3", "", "7"), ("4", "a", "8")])
    right = frame(spark, "cust name amount", [("a", "Ann", "x"), ("a", "Abe", "y"), ("", "None", "z"), ("STRASSE", "S", "w")]).withColumnRenamed("_ord", "_at")
    found = joins.join(left, right, "cust", order=["_ord"], right_order=["_at"])
    assert found.df.columns == ["_ord", "order", "cust", "amount", "name", "amount_right"]
    assert shown(found.df) == [("1", " a ", "5", "Ann", "x"), ("1", " a ", "5", "Abe", "y"), ("3", "", "7", "None", "z"), ("4", "a", "8", "Ann", "x"), ("4", "a", "8", "Abe", "y")]
    found = joins.join(left, right, "cust", how="left", order=["_ord"], right_order=["_at"])
    assert shown(found.df)[2] == ("2", "b", "6", "", "") and found.count("unmatched") == 1
    street = frame(spark, "cust x", [("straße", "1")])
    assert shown(joins.join(street, right.drop("_at"), "cust", ignore_case=True).df) == [("straße", "1", "S", "w")]
    with pytest.raises(ValueError):
        joins.join(left, right, "cust", how="outer")


def test_diff(spark):
    old = frame(spark, "id name city", [("1", "Ann", "X"), ("2", "Bob", "Y"), ("3", "Cy", "Z")])
    new = frame(spark, "city id name", [("X", "1", "Ann "), ("Q", "2", "Bob"), ("W", "4", "Di")])
    found = joins.diff(old, new, "id")
    assert sorted((r["op"], r["id"]) for r in found.df.collect()) == [("+", "4"), ("-", "3"), ("=", "1"), ("~", "2")]
    assert [(c["column"], c["old"], c["new"]) for r in found.df.where("op = '~'").collect() for c in r["changes"]] == [("city", "Y", "Q")]
    assert [found.count(n) for n in ("added", "removed", "changed", "unchanged")] == [1] * 4
    with pytest.raises(joins.KeyProblem):
        joins.diff(frame(spark, "id name", [("1", "a"), (" 1", "b")]), new, "id")


ORDERS = [("NL", "open", "0.10"), ("NL ", "paid", "0.20"), ("", "open", ""), ("DE", "open", "5"), ("10", "x", "1e2"), ("9", "x", "3"), ("de", "y", "4")]


def test_group(spark):
    df = frame(spark, "country status amount", ORDERS)
    got = shown(aggregates.group(df, "country", ["count", "amount:sum", "amount:mean", "amount:max", "status:distinct", "amount:median"]))
    assert [r[0] for r in got] == ["9", "10", "DE", "de", "NL", "(blank)"]
    by = {r[0]: r for r in got}
    assert [str(x) for x in by["NL"][1:]] == ["2", "0.300000", "0.15", "0.200000", "2", "0.1500000"]
    assert by["(blank)"][1:] == (1, None, None, None, 1, None)
    with pytest.raises(Refused):
        aggregates.group(frame(spark, "k v", [("a", "1"), ("b", "x")]), "k", ["v:sum"])


def test_medians_of_skewed_values(spark):
    """One value for most rows, values far apart, values that are the same double, and groups of one and two."""
    rows = [("hot", "5")] * 3000 + [("hot", str(i)) for i in range(2000)] + [("far", str(10 ** (i % 17))) for i in range(999)] + [("one", "7"), ("two", "1"), ("two", "2")]
    rows += [("fine", f"1234567890123456.{i:06d}") for i in range(400)] + [("none", "")]
    import statistics
    from decimal import Decimal

    want = {k: statistics.median([Decimal(v) for q, v in rows if q == k]) for k in ("hot", "far", "one", "two", "fine")} | {"none": None}
    df = spark.createDataFrame(rows, "k string, v string").repartition(5)
    assert {r["k"]: r["v_median"] for r in aggregates.group(df, "k", ["v:median"]).collect()} == want


def test_medians_of_large_groups(spark):
    df = spark.range(30_001).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), ((F.col("id") * 7919) % 30_001).cast("decimal(18,2)").alias("v"))
    pairs = sorted((r["k"], float(r["v"])) for r in df.collect())
    import statistics

    want = {k: statistics.median(v for q, v in pairs if q == k) for k in "ab"}
    assert {r["k"]: float(r["v_median"]) for r in aggregates.group(df, "k", ["v:median"]).collect()} == want


def test_freq(spark):
    df = frame(spark, "country status", [("NL", "a"), ("nl", "a"), ("NL", "b"), ("DE", "a"), ("", ""), ("de", "a"), ("be", "")])
    assert shown(aggregates.freq(df, "country", share=None))[:2] == [("NL", 2), ("", 1)]
    assert shown(aggregates.freq(df, "country", ignore_case=True, blanks=False)) == [("NL", 3, 50.0), ("DE", 2, 33.3), ("be", 1, 16.7)]
    nums = frame(spark, "rating", [("10",), ("9",), ("10",), ("n/a",), ("",), ("9",), ("2",)])
    assert shown(aggregates.freq(nums, "rating", by_value=True, share=None)) == [("2", 1), ("9", 2), ("10", 2), ("n/a", 1), ("", 1)]


def test_profile(spark):
    df = frame(spark, "city temp note", [("X", "1.5", ""), ("Y", "2", ""), ("X", "", ""), ("", "1_0", "")])
    got = {r["column"]: r for r in aggregates.profile(df).collect()}
    assert (got["city"]["filled"], got["city"]["empty"], got["city"]["distinct"], got["city"]["numeric"]) == (3, 1, 2, False)
    assert got["temp"]["numeric"] is False and got["note"]["filled"] == 0 and got["note"]["min"] is None
    one = {r["column"]: r for r in aggregates.profile(frame(spark, "n", [("1,5",), ("2,25",)]), decimal_comma=True).collect()}["n"]
    assert (one["min"], one["max"], one["mean"]) == (1.5, 2.25, 1.875)


def test_unique(spark):
    df = frame(spark, "id name n", [("1", "a", "x"), (" 1 ", "b", "y"), ("2", "c", "z"), ("A", "d", "q"), ("a", "e", "r")])
    assert shown(dedup.unique(df, "id"), "_ord") == [("1", "a", "x"), ("2", "c", "z"), ("A", "d", "q"), ("a", "e", "r")]
    assert shown(dedup.unique(df, "id", keep="last", ignore_case=True, count="k"), "_ord") == [(" 1 ", "b", "y", 2), ("2", "c", "z", 1), ("a", "e", "r", 2)]
    assert shown(dedup.repeated(df, "id"), "_ord") == [("1", "a", "x"), (" 1 ", "b", "y")]


def test_projection(spark):
    df = frame(spark, "id name email", [("1", "Ann", "a@x"), ("2", "", "b@x")]).drop("_ord")
    assert projection.cut(df, keep="email,id", rename=["id=key"]).columns == ["email", "key"]
    assert projection.cut(df, drop="name").columns == ["id", "email"]
    with pytest.raises(NameProblem):
        projection.cut(df, drop="id,name,email")
    messy = frame(spark, "A A_ _x", [(" a ", "", "1"), ("", " ", "2"), ("a", "", "3")]).toDF("_ord", "First Name", "first-name", "_x")
    assert [tuple(r) for r in projection.clean(messy, drop_repeats=True).select("first_name", "first_name_2").collect()] == [("a", "")]
    other = frame(spark, "name id", [("Bo", "3")]).drop("_ord")
    with pytest.raises(NameProblem):
        projection.stack([("a", df), ("b", other)])
    out = projection.stack([("a", df), ("b", other)], union=True, source="source")
    assert out.columns == ["source", "id", "name", "email"] and Counter(map(tuple, out.collect()))[("b", "3", "Bo", "")] == 1
    found = projection.split_column(frame(spark, "id place n", [("1", "X, Y", "a"), ("2", "Z", "b"), ("3", "", "c")]), "place", ["city", "land"], sep=",")
    assert shown(found.df, "_ord") == [("1", "X", "Y", "a"), ("2", "Z", "", "b"), ("3", "", "", "c")] and found.count("short") == 1
    out = projection.merge_columns(frame(spark, "id first x last", [("1", "Ann", "q", " Dyk "), ("2", "", "r", "Bo")]), "first,last", "name")
    assert out.columns == ["_ord", "id", "name", "x"] and shown(out, "_ord") == [("1", "Ann Dyk", "q"), ("2", "Bo", "r")]


def test_reshape(spark):
    wide = frame(spark, "store jan feb", [("N", "1", ""), ("S", "3", "4")])
    long = reshape.melt(wide, "store", skip_blank=True)
    assert sorted(shown(long)) == [("N", "jan", "1"), ("S", "feb", "4"), ("S", "jan", "3")]
    back = reshape.pivot(reshape.melt(wide, "store").withColumn("_pos", F.when(F.col("variable") == "jan", 0).otherwise(1)), "variable", "value", "store", order=["_ord", "_pos"])
    assert back.columns == ["store", "jan", "feb"] and shown(back) == [("N", "1", ""), ("S", "3", "4")]
    twice = frame(spark, "k h v", [("a", "x", "1"), ("a", "x", "2"), ("b", "y", "3")])
    with pytest.raises(reshape.PivotProblem):
        reshape.pivot(twice, "h", "v", "k")
    assert shown(reshape.pivot(twice, "h", "v", "k", keep="last", fill="-")) == [("a", "2", "-"), ("b", "-", "3")]
    assert [tuple(r) for r in reshape.transpose(wide).collect()] == [("jan", "1", "3"), ("feb", "", "4")] and reshape.transpose(wide).columns == ["store", "N", "S"]
    ragged = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["1"]), (2, ["2", "x"])], "_ord long, cells array<string>")
    assert [r["cells"] for r in reshape.transpose_cells(ragged).collect()] == [["a", "1", "2"], ["b", "", "x"], ["c"]]
    with pytest.raises(reshape.TooLarge):
        reshape.transpose_cells(ragged, most=8)


def test_cells(spark):
    df = frame(spark, "id amount day", [("1", "1.234,50", "4/3/2026"), ("2", "x", "31/2/2026"), ("3", "", "")])
    found = cells.numbers_of(df, "amount")
    assert [r[1] for r in shown(found.df, "_ord")] == ["1234.50", "x", ""] and [(r["column"], r["value"]) for r in found.problems.collect()] == [("amount", "x")]
    with pytest.raises(Refused):
        found.strict()
    found = cells.dated(df, "day")
    assert [r[2] for r in shown(found.df, "_ord")] == ["2026-03-04", "31/2/2026", ""] and found.problems.count() == 1
    found = cells.rounded(frame(spark, "a b", [("1.005", "2.5"), ("q", "-0.001")]), "a,b", 2)
    assert shown(found.df, "_ord") == [("1.01", "2.50"), ("q", "0.00")]
    found = cells.binned(frame(spark, "age n", [("5", "a"), ("70", "b"), ("z", "c"), ("", "d"), ("18", "e")]), "age", "0,18,65")
    assert shown(found.df, "_ord") == [("5", "[0, 18)", "a"), ("70", "", "b"), ("z", "", "c"), ("", "", "d"), ("18", "[18, 65)", "e")]
    assert sorted(r["message"] for r in found.problems.collect()) == ["not a plain number", "outside the edges"]
    assert [tuple(r) for r in found.counters["bins"].collect()] == [("[0, 18)", 1), ("[18, 65)", 1)]
    found = cells.replaced(frame(spark, "a b", [("x1", "x2"), ("y", "x")]), "x", "z", "a")
    assert shown(found.df, "_ord") == [("z1", "x2"), ("y", "x")] and found.counters["changed"].first()[0] == 1
    assert shown(cells.masked(frame(spark, "a b", [("secret", "x")]), "a:mask,b:blank")) == [("**cret", "")]


def test_check(spark):
    df = frame(spark, "id email amount day", [("1", "a@x.com", "5", "2026-02-30"), ("2", "bad", "", "2026-02-28"), ("1", "", "x", ""), ("", "c@x.org", "1e3", "2026-1-1")])
    got = [(r["_ord"], r["column"], r["rule"], r["first"]) for r in checks.check(df, "id:required,id:unique,email:email,amount:number,day:date").collect()]
    assert got == [(0, "day", "date", None), (1, "email", "email", None), (2, "id", "unique", 0), (2, "amount", "number", None), (3, "id", "required", None), (3, "day", "date", None)]


def test_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "_ord").repartition(5)
    a = [r[0] for r in sampling.sample(df, n=10, seed=1).collect()]
    assert len(a) == 10 and a == sorted(a) == [r[0] for r in sampling.sample(df.repartition(2), n=10, seed=1).collect()]
    assert a != [r[0] for r in sampling.sample(df, n=10, seed=2).collect()]
    assert sampling.sample(df, fraction=0.125).count() == 12 and sampling.sample(df, n=500).count() == 100


def test_lines_and_words(spark):
    rows = lines.lines_of(spark.createDataFrame([(0, "b\na\nB \n\nb\n")], "_ord long, text string"), order=["_ord"])
    go = lambda **k: [tuple(r) for r in lines.dedupe(rows, order=["_line"], **k).drop("_ord", "_line").collect()]
    assert go() == [("b",), ("a",), ("B ",), ("",)] and go(keep="last", ignore_case=True, ignore_space=True, skip_blank=True) == [("a",), ("b",)]
    assert go(counts=True)[0] == (2, "b") and [tuple(r)[:1] for r in lines.repeated(rows, order=["_line"]).collect()] == [(2,)]
    assert [r["line"] for r in lines.count_prefixed(lines.repeated(rows, order=["_line"])).collect()] == ["2 b"]
    texts = spark.createDataFrame([(0, "The cat. The dog's cat!"), (1, "dog a")], "_ord long, text string")
    assert [tuple(r) for r in lines.word_counts(texts).collect()] == [("the", 2), ("cat", 2), ("dog's", 1), ("dog", 1), ("a", 1)]
    stops = spark.createDataFrame([("the a",)], "text string")
    assert [tuple(r) for r in lines.word_counts(texts, stop_words=stops, top=2, min_count=2, min_length=2).collect()] == [("cat", 2)]
    assert tuple(lines.word_totals(texts).first()) == (2, 2, 7, 28, 5)


def test_json(spark):
    texts = spark.createDataFrame([(0, '{"data": [{"a": 1, "b": {"c": true}}, {"d": ["x", "y"], "a": null}]}')], "_ord long, text string")
    table = records.flat_table(records.records_of(texts, path="data"), sep=";")
    assert table.columns == ["a", "b.c", "d"] and [tuple(r) for r in table.collect()] == [("1", "true", ""), ("", "", "x;y")]
    found = records.records_of(spark.createDataFrame([('{"a": 1}\n\n{"a": 2}\n',)], "text string"), lines=True)
    assert [tuple(r) for r in records.flat_table(found).collect()] == [("1",), ("2",)]
    df = frame(spark, "id a.b a.c", [("05", "1.5", "")])
    assert records.as_json(df, nest=True).first()[0] == '{"id": "05", "a": {"b": 1.5, "c": null}}'
    assert records.as_json(df, typed=False).first()[0] == '{"id": "05", "a.b": "1.5", "a.c": ""}'
    with pytest.raises(NameProblem):
        records.as_json(frame(spark, "a a.b", [("1", "2")]), nest=True)
    got = records.reformatted(spark.createDataFrame([('{"b":1.50,\n"a":[1]}',), ('{"a":\nx}',)], "text string"), indent=None, sort_keys=True).collect()
    assert got[0]["formatted"] == '{"a":[1],"b":1.5}' and got[1]["error"].startswith("2:1")
    rows = records.reformatted(spark.createDataFrame([('{"a": 1}\n\n[1, 2]\nx',)], "text string"), lines=True).collect()
    assert [(r["_line"], r["formatted"]) for r in rows] == [(1, '{"a":1}'), (3, "[1,2]"), (4, None)]


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"same\r\n", "b.txt": b"same\r\n", "c.txt": b"x\ny\r", "d.bin": b"\0\n", "e.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    from tabloom.sources import delimited

    table = delimited.read_files(spark, str(tmp_path))
    dupes = files.duplicates(table).collect()
    assert [(r["size"], [p.rsplit("/", 1)[1] for p in r["paths"]], r["reclaimable"]) for r in dupes] == [(6, ["a.txt", "b.txt"], 6)]
    ends = {r["path"].rsplit("/", 1)[1]: (r["crlf"], r["lf"], r["cr"], r["style"]) for r in files.line_ends(table).collect()}
    assert ends["a.txt"] == (1, 0, 0, "crlf") and ends["c.txt"] == (0, 1, 1, "mixed") and ends["d.bin"] == (None, None, None, None) and "e.txt" not in ends
    assert files.apply_contents(files.with_line_ends(table)) == 3
    assert (tmp_path / "a.txt").read_bytes() == b"same\n" and (tmp_path / "c.txt").read_bytes() == b"x\ny\n" and (tmp_path / "d.bin").read_bytes() == b"\0\n"
    names = spark.createDataFrame([("f", "a1.txt"), ("f", "A2.txt"), ("f", "a3.txt"), ("f", "b3.txt")], "folder string, name string")
    plan = {r["old"]: (r["new"], r["problem"]) for r in files.rename_plan(names, "^a", "b").collect()}
    assert plan == {"a1.txt": ("b1.txt", None), "a3.txt": ("b3.txt", "exists already")}
    assert files.apply_renames([(str(tmp_path), "a.txt", "b.txt"), (str(tmp_path), "b.txt", "a.txt")]) == 2
