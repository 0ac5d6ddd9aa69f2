"""Cell functions, by tables of cases."""

from __future__ import annotations

import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabloom.functions import dates, numbers, text
from tabloom.functions import json as js
from tabloom.plans import names, render, specs
from tabloom.sources.delimited import SourceProblem, sniffed


def each(spark, cases, **columns):
    """The columns of each case's text, in order."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *[make(F.col("c")).alias(n) for n, make in columns.items()]).orderBy("i").collect()]


def test_trim_fold_words(spark):
    cases = ["  a b\t", " x ", "\x1cq\x1f", "", None, "Straße", "İ"]
    got = each(spark, cases, s=lambda c: text.strip(text.cell(c)), f=lambda c: text.casefold(text.cell(c)), b=text.is_blank)
    assert got == [((c or "").strip(), (c or "").casefold(), not (c or "").strip()) for c in cases]
    found = each(spark, ["It's a well-known fact: x_y 2nd.", "ÉTÉ été"], w=lambda c: text.words(c), v=lambda c: text.words(c, exact=False))
    assert found[0] == (["it's", "a", "well-known", "fact", "x", "y", "2nd"],) * 2 and found[1][0] == ["été", "été"]


def test_lines(spark):
    cases = ["a\nb", "a\r\nb\n", "", "\n", "a\x0bb\x85c d", "a\n\nb\n\n"]
    assert [r[0] for r in each(spark, cases, x=text.lines)] == [c.splitlines() for c in cases]


def test_what_is_a_number(spark):
    cases = ["5", " 5.0 ", "1e3", "-.5", "5.", "1_000", "nan", "inf", "1d", "0x10", "1e999", "", "a", "+7", "1_0.5_0", "_1", None]
    def plain(c, under):
        return specs.float_text(c or "", under)
    got = each(spark, cases, a=lambda c: numbers.floating(c), b=lambda c: numbers.floating(c, underscores=True))
    assert got == [(plain(c, False), plain(c, True)) for c in cases]
    assert each(spark, ["1.234,5", "12,5", "1.5", "1.234.567", "x"], a=numbers.comma_floating) == [(1234.5,), (12.5,), (None,), (1234567.0,), (None,)]


NUMBERS = [
    ("1.234,50", "auto", "1234.50"), ("1,234.50", "auto", "1234.50"), ("1234", "auto", "1234"), ("(12.00)", "auto", "-12.00"), ("12,50-", "auto", "-12.50"), ("€ 1.234,50", "auto", "1234.50"), ("-€5", "auto", "-5"),
    ("1'234.5", "auto", "1234.5"), ("1 234", "auto", "1234"), ("1 234,5", "auto", "1234.5"), ("1.234.567", "auto", "1234567"), ("1,234", "auto", None), ("1.234", "auto", None), (",234", "auto", "0.234"), ("0.5", "auto", "0.5"),
    ("USD 7", "auto", "7"), ("7 chf", "auto", "7"), ("abc", "auto", None), ("", "auto", None), ("1.2.3", "auto", None), ("12 34", "auto", None), ("1,234", "dot", "1234"), ("1,234", "comma", "1.234"), ("1.234", "comma", "1234"),
    ("1.5", "comma", None), ("-0", "auto", "0"), ("-0.00", "auto", "0.00"), ("5.", "auto", None), ("--5", "auto", None), ("+5", "auto", "5"), ("1.234,567,8", "auto", None), ("12.345.67", "auto", None), ("007,5", "auto", "7.5"), ("£.5", "auto", "0.5"),
]


def test_locale_numbers(spark):
    for mark in ("auto", "dot", "comma"):
        cases = [(c, want) for c, m, want in NUMBERS if m == mark]
        assert list(zip([c for c, _ in cases], [r[0] for r in each(spark, [c for c, _ in cases], x=lambda c: numbers.locale_text(c, mark))])) == cases


ROUNDED = [
    ("2.345", 2, "half-up", "2.35"), ("2.5", 0, "half-up", "3"), ("2.5", 0, "half-even", "2"), ("-2.5", 0, "half-up", "-3"), ("2.349", 2, "down", "2.34"), ("-2.349", 2, "down", "-2.34"), ("-2.341", 2, "floor", "-2.35"),
    ("2.341", 2, "ceiling", "2.35"), ("1250", -2, "half-up", "1300"), ("1250", -2, "half-even", "1200"), ("-0.004", 2, "half-up", "0.00"), ("5", 2, "half-up", "5.00"), ("12345678901234567890.125", 2, "half-up", "12345678901234567890.13"),
    ("1e3", 2, "half-up", None), ("x", 2, "half-up", None), ("", 2, "half-up", None), (".5", 1, "half-up", "0.5"),
]


@pytest.mark.parametrize("places, mode", sorted({c[1:3] for c in ROUNDED}))
def test_rounding(spark, places, mode):
    cases = [c for c in ROUNDED if c[1:3] == (places, mode)]
    assert [r[0] for r in each(spark, [c[0] for c in cases], x=lambda c: numbers.rounded(c, places, mode))] == [c[3] for c in cases]


def test_bins(spark):
    edges, written = specs.edges("0, 18, 65")
    label = lambda right, opened: lambda c: numbers.bin_label(numbers.plain(c), edges, specs.labels(written, right, opened), right, opened)
    got = each(spark, ["0", "17.9", "18", "65", "-1", "x"], a=label(False, False), b=label(True, False), c=label(False, True), d=label(True, True))
    assert [r[0] for r in got] == ["[0, 18)", "[0, 18)", "[18, 65)", None, None, None]
    assert [r[1] for r in got] == [None, "(0, 18]", "(0, 18]", "(18, 65]", None, None]
    assert [r[2] for r in got] == ["[0, 18)", "[0, 18)", "[18, 65)", ">= 65", "< 0", None]
    assert [r[3] for r in got] == ["<= 0", "(0, 18]", "(0, 18]", "(18, 65]", "<= 0", None]


DATES = [
    ("2026-03-04", "2026-03-04"), ("2026/3/4", "2026-03-04"), ("4.3.2026", "2026-03-04"), ("04-03-2026", "2026-03-04"), ("20260304", "2026-03-04"), ("4 Mar 2026", "2026-03-04"), ("4 March 2026", "2026-03-04"), ("Mar 4, 2026", "2026-03-04"),
    ("march 4 2026", "2026-03-04"), ("2026-03-04T23:59:59Z", "2026-03-04"), ("2026-03-04 10:00", "2026-03-04"), ("31/02/2026", None), ("2026-13-01", None), ("soon", None), ("", None), ("  4   Mar  2026 ", "2026-03-04"), ("29.2.2024", "2024-02-29"), ("29.2.2023", None),
]


def test_dates(spark):
    got = each(spark, [c for c, _ in DATES], x=dates.parsed, y=lambda c: dates.normalised(c), z=lambda c: dates.parsed(c, True))
    assert [None if r[0] is None else r[0].isoformat() for r in got] == [d for _, d in DATES]
    assert [r[1] for r in got] == [d or c for c, d in DATES]
    assert got[2][2].isoformat() == "2026-04-03" and got[11][2] is None


def test_masks(spark):
    got = each(spark, ["secret", " Bob@Example.COM ", "ab", "", None, "a@b@c"], h=lambda c: text.hash_token(c, "salt"), m=text.masked, e=lambda c: text.email_token(c, "salt"), long=lambda c: text.hash_token(c, "k" * 80))
    token = lambda s, k="salt": hmac.new(k.encode(), s.encode(), hashlib.sha256).hexdigest()[:12] if s else ""
    assert [r[0] for r in got] == [token(s) for s in ("secret", "Bob@Example.COM", "ab", "", "", "a@b@c")]
    assert [r[1] for r in got] == ["**cret", "***********.COM", "**", "", "", "*@b@c"]
    assert [r[2] for r in got] == [token("secret"), token("Bob") + "@example.com", token("ab"), "", "", token("a@b@c")]
    assert got[0][3] == token("secret", "k" * 80)


def test_replace(spark):
    go = lambda s, *a, **k: each(spark, [s], x=lambda c: text.replaced(c, *a, **k))[0][0]
    assert go("John Smith", r"(\w+) (\w+)", r"\2, \1") == "Smith, John"
    assert go("a1b22", r"(?P<n>\d+)", r"<\g<n>>") == "a<1>b<22>"
    assert go("1.5 $", ".", "$1", literal=True) == "1$15 $"
    assert go("ABC abc", "b", "-", ignore_case=True) == "A-C a-c"
    assert go("yes", "y|yes", "1", whole=True) == "1" and go(" yes", "yes", "1", whole=True) == " yes"
    assert go("A.B", "a.b", "$", literal=True, ignore_case=True, whole=True) == "$"
    assert go(None, "x", "y") == ""


def test_parts(spark):
    go = lambda s, n, **k: list(each(spark, [s], **{f"p{i}": (lambda c, i=i: text.padded_parts(c, n, **k)[i]) for i in range(n)})[0])
    assert go("a, b, c", 2, sep=",") == ["a", "b, c"]
    assert go("a, b, c", 2, sep=",", from_right=True) == ["a, b", "c"]
    assert go("one", 3, sep=",") == ["one", "", ""] and go("one", 3, sep=",", from_right=True) == ["", "", "one"]
    assert go("  Ann  van  Dyk ", 2) == ["Ann", "van  Dyk"] and go("Ann van  Dyk", 2, from_right=True) == ["Ann van", "Dyk"]
    assert go("", 2, sep=",") == ["", ""]


def test_file_names(spark):
    cases = ["a/b", "con.txt", "x ", "ok.csv", "a:b", "..", "é_1"]
    got = each(spark, cases, p=text.name_problem, s=text.safe_name)
    assert [bool(r[0]) for r in got] == [True, True, True, False, True, True, False]
    assert [r[1] for r in got] == ["a_b", "con.txt", "x", "ok.csv", "a_b", "empty", "é_1"]


def test_json_cells(spark):
    got = each(spark, ["5", "05", "1.50", "true", "FALSE", "", "a\"b", "-3", "1e5", "null"], x=numbers.json_typed)
    assert [r[0] for r in got] == ["5", '"05"', "1.50", "true", "false", "null", '"a\\"b"', "-3", '"1e5"', '"null"']


def test_specs():
    c = specs.condition("a b>= 5")
    assert (c.column, c.op, c.value, c.number) == ("a b", ">=", "5", 5.0)
    assert specs.condition("x!~^a=b").op == "!~" and specs.condition("a=b>c").op == "="
    for bad in ("a", "=5", "a > x", "a ~ ("):
        with pytest.raises(specs.SpecProblem):
            specs.condition(bad)
    assert specs.aggregate("a:b:Sum") == specs.Aggregate("sum", "a:b") and specs.aggregate("a:sum").label == "a_sum"
    assert specs.sort_key("a:desc", ["a"]) == ("a", True) and specs.sort_key("a:desc", ["a:desc"]) == ("a:desc", False)
    assert specs.mask("a:email") == ("a", "email") and specs.mask("a") == ("a", "hash")
    assert specs.byte_size("1.5K") == 1536 and specs.human_size(1536) == "1.5K" and specs.human_size(1023) == "1023B" and specs.human_size(5 << 40) == "5120.0G"
    assert specs.edges("1,2.5")[0] == [Decimal(1), Decimal("2.5")]
    for bad in ("1", "2,1", "1,x"):
        with pytest.raises(specs.SpecProblem):
            specs.edges(bad)
    assert sniffed("a;b\n1;2\n3;4\n") == ";" and sniffed("a\tb\n1\t2") == "\t" and sniffed('"a,b";c\n"d,e";f') == ";"


def test_names():
    assert names.clean_headers(["First Name", "firstName", "", "%", "First Name"]) == ["first_name", "first_name_2", "column_3", "column_4", "first_name_3"]
    assert names.renamed(["a", "b"], ["a=b", "b=a"]) == ["b", "a"]
    assert names.globbed(["2026-*"], ["id", "2026-1", "2026-2"], ["id"]) == ["2026-1", "2026-2"]
    for bad in (lambda: names.renamed(["a", "b"], ["a=b"]), lambda: names.require(["z"], ["a"]), lambda: names.globbed(["q*"], ["a"])):
        with pytest.raises(names.NameProblem):
            bad()


def test_render():
    out = render.aligned(["name", "n"], [["Ann", "1"], ["木", "20"]])
    assert out.split("\n") == ["name   n", "----  --", "Ann    1", "木    20"]
    assert render.fitted("abcdef", 4) == "abc…" and render.width("木é") == 3


def test_json_text():
    assert js.flat({"a": {"b": 1, "c": None}, "d": [1, "x"], "e": [{"f": 1}], "g": {}, "h": True}, ";") == {"a.b": "1", "a.c": "", "d": "1;x", "e": '[{"f": 1}]', "h": "true"}
    for bad in ('{"a": NaN}', "", "[1,", '{"a":1,"a":2}'):
        with pytest.raises(js.JsonProblem):
            js.load(bad, strict_keys=True)
    assert js.load('{"a":1,"a":2}') == {"a": 2}
    assert js.walk({"a": [{"b": 5}]}, ["a", "0", "b"]) == 5


def test_unclear_delimiter():
    for sample in ("", "x", "one\ntwo\nthree", "a,b\nc\nd\ne"):
        with pytest.raises(SourceProblem):
            sniffed(sample)


def test_json_hint():
    with pytest.raises(ValueError, match="try the path rows"):
        js.records({"n": 1, "rows": [{"a": 1}], "more": []})
    assert js.records({"n": 1}) == [{"n": 1}]


def test_strip_knows_all_of_unicode(spark):
    """Each character alone, at both ends of a text, and within one: as Python's strip."""
    cases = [f"{chr(i)}{chr(i)}a{chr(i)}b{chr(i)}" for i in range(0x3100) if not 0xD800 <= i < 0xE000] + ["\U0001f600 ", "", " ", None]
    assert [r[0] for r in each(spark, cases, s=lambda c: text.strip(text.cell(c)))] == [(c or "").strip() for c in cases]


def test_rounding_reads_its_cell_once(spark):
    """However many steps it takes; a cell that is read at every step is trimmed and matched there again."""
    df = spark.createDataFrame([("2.345",)], "cell_read string")
    for places in (2, 0, -2):
        for mode in numbers.MODES:
            plan = df.select(numbers.rounded(F.col("cell_read"), places, mode).alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0]
            assert plan.count("cell_read#") == 1


def test_rounding_of_long_numbers(spark):
    cases = ["9" * 38, "9" * 38 + ".4", "9" * 38 + ".5", "-" + "9" * 38 + ".9", "0" * 60 + "1.5", "1" * 39, "0." + "0" * 60 + "5", "3." + "5" * 60]
    got = each(spark, cases, up=lambda c: numbers.rounded(c, 0), down=lambda c: numbers.rounded(c, 0, "down"), ceiling=lambda c: numbers.rounded(c, 1, "ceiling"), tens=lambda c: numbers.rounded(c, -1))
    assert [r[0] for r in got] == ["9" * 38, "9" * 38, None, None, "2", None, "0", "4"]
    assert [r[1] for r in got] == ["9" * 38, "9" * 38, "9" * 38, "-" + "9" * 38, "1", None, "0", "3"]
    assert [r[2] for r in got] == [None, None, None, None, "1.5", None, "0.1", "3.6"]
    assert [r[3] for r in got] == ["1" + "0" * 38, "1" + "0" * 38, "1" + "0" * 38, "-1" + "0" * 38, "0", "1" * 38 + "0", "0", "0"]
