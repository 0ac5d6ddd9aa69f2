"""Sources and sinks, round trips through files."""

from __future__ import annotations

import csv
import json

import pytest

from tabloom import streaming
from tabloom.operators import lines, records
from tabloom.plans import render
from tabloom.sources import delimited, sinks


def test_ragged(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("﻿id,note\n1,\"a\nb\"\n\n2\n3,x,y\n".encode())
    rows = delimited.read_ragged(spark, str(path)).orderBy("_ord").collect()
    assert [(r["_line"], r["_line_end"], r["cells"]) for r in rows] == [(1, 1, ["id", "note"]), (2, 3, ["1", "a\nb"]), (5, 5, ["2"]), (6, 6, ["3", "x", "y"])]
    ragged = delimited.read_ragged(spark, str(path))
    assert [tuple(r) for r in delimited.ragged_report(ragged).collect()] == [(5, 1), (6, 3)]
    table = delimited.tabular(ragged, lines=True)
    assert [tuple(r)[1:] for r in table.orderBy("_ord").collect()] == [(2, 3, "1", "a\nb"), (5, 5, "2", ""), (6, 6, "3", "x")]
    with pytest.raises(delimited.SourceProblem):
        delimited.tabular(ragged, long="error")
    assert [tuple(r) for r in delimited.read_table(spark, str(path)).limit(1).collect()] == [("1", "a\nb")]


def test_encodings(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("prijs;naam\n5;é€\n".encode("cp1252"))
    assert delimited.sniff(spark, str(path), "cp1252") == ";"
    assert delimited.read_ragged(spark, str(path), ";", "cp1252").orderBy("_ord").collect()[1]["cells"] == ["5", "é€"]
    with pytest.raises(Exception, match="byte 0xe9 at offset 13"):
        delimited.read_ragged(spark, str(path), ";").collect()
    with pytest.raises(delimited.SourceProblem):
        delimited.checked_codec("nonsense")


def test_fixed_width(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("id   first name   amount\n1    Ann Dyk         5.0\n\n22   Bo             12.5\n")
    rows = lines.lines_of(delimited.read_text(spark, str(path)))
    table = delimited.fixed_width(rows)
    assert table.columns == ["_ord", "id", "first name", "amount"]
    assert [tuple(r)[1:] for r in table.orderBy("_ord").collect()] == [("1", "Ann Dyk", "5.0"), ("22", "Bo", "12.5")]
    table = delimited.fixed_width(rows, widths="5,10,9", header=["a", "b", "c"], skip=1)
    assert [tuple(r)[1:] for r in table.orderBy("_ord").collect()] == [("1", "Ann Dyk", "5.0"), ("22", "Bo", "12.5")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i), "NL" if i % 2 else "n l", 'a "q"\n') for i in range(7)], "_ord long, id string, country string, note string")
    out = tmp_path / "o.csv"
    assert sinks.one_csv(df, str(out)) == 7
    assert list(csv.reader(out.open(newline="")))[2] == ["1", "NL", 'a "q"\n']
    with pytest.raises(sinks.SinkProblem):
        sinks.one_csv(df, str(out))
    with pytest.raises(sinks.SinkProblem):
        sinks.one_csv(df, str(out), inputs=[str(out)], force=True)
    sinks.one_csv(df, str(out), line_end="\r\n", bom=True, force=True, delimiter="tab")
    assert out.read_bytes().startswith(b"\xef\xbb\xbfid\tcountry\tnote\r\n")
    assert [p.rsplit("/", 1)[1] for p in sinks.split_by_rows(df, str(tmp_path / "parts"), "t", 3)] == ["t_001.csv", "t_002.csv", "t_003.csv"]
    assert [p.rsplit("/", 1)[1] for p in sinks.split_by_value(df, str(tmp_path / "by"), "t", "country")] == ["t_NL.csv", "t_n_l.csv"]
    sinks.csv_folder(df, str(tmp_path / "folder"))
    assert delimited.read_table(spark, str(tmp_path / "folder")).count() == 7
    rows = records.as_json(df.select("_ord", "id", "country"))
    assert sinks.one_json(rows, str(tmp_path / "o.json")) == 7 and json.loads((tmp_path / "o.json").read_text())[1] == {"id": 1, "country": "NL"}
    sinks.json_lines(rows, str(tmp_path / "jl"))
    assert spark.read.json(str(tmp_path / "jl")).count() == 7
    assert render.look(df.select("_ord", "id"), 2).split("\n") == ["id", "--", " 0", " 1"]


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", streaming.windowed_counts(stream, "ts", ["event_type"]), "complete"), ("u", streaming.unique_within(stream, "ts", ["event_id"]), "append")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    want = streaming.windowed_counts(source, "ts", ["event_type"])
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
    assert spark.table("u").count() == source.count()


def test_tables_are_split_unless_cells_hold_line_ends(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    rows = [(str(i), f'a "quoted" cell, {i}') for i in range(3000)]
    for path, extra in ((plain, []), (broken, [("x", "two\nlines")])):
        with path.open("w", newline="") as file:
            csv.writer(file, lineterminator="\n").writerows([("id", "note"), *rows, *extra])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        found = delimited.read_table(spark, str(plain))
        assert found.rdd.getNumPartitions() > 4 and sorted(map(tuple, found.collect())) == sorted(rows)
        found = delimited.read_table(spark, str(broken))
        assert sorted(map(tuple, found.collect())) == sorted([*rows, ("x", "two\nlines")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_lines_are_split_among_tasks(spark, tmp_path):
    """Lines of two files, cut at all of Python's line ends and numbered over the splits; no task gets a file whole."""
    ends = ["\n", "\r\n", "\r", "\n\n", "\x0b", "\x85", " ", "\x1d\n"]
    texts = {name: "﻿" + "".join(f'{{"{k}": "{name} {i} é"}}{ends[i % len(ends)]}' for i in range(3000)) for name, k in (("b + 1%.jsonl", "x"), ("a é.jsonl", "y"))}
    for name, value in texts.items():
        (tmp_path / name).write_bytes(value.encode())
    want = [(name, i, line) for name in sorted(texts) for i, line in enumerate(texts[name].removeprefix("﻿").splitlines(), 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = delimited.read_lines(spark, f"{tmp_path}/*.jsonl")
        assert rows.rdd.getNumPartitions() > 8
        got = [tuple(r) for r in rows.orderBy("_ord").collect()]
        assert [(f.rsplit("/", 1)[1], n, t) for f, _, n, t in got] == want and [o for _, o, _, _ in got] == list(range(len(want)))
        assert {f for f, _, _, _ in got} == {r["_file"] for r in delimited.read_text(spark, f"{tmp_path}/*.jsonl").collect()}
        table = records.flat_table(records.records_of(rows, lines=True))
        assert table.columns == ["y", "x"] and [r["y"] or r["x"] for r in table.collect()] == [f"{n} {i} é" for n in sorted(texts) for i in range(3000)]
        n = next(n for name, n, line in want if name == "a é.jsonl" and " 2900 " in line)
        (tmp_path / "a é.jsonl").write_bytes(texts["a é.jsonl"].replace('{"y": "a é.jsonl 2900', '{"y": NaN, "a é.jsonl 2900').encode())
        bad = records.records_of(delimited.read_lines(spark, f"{tmp_path}/a*.jsonl"), lines=True)
        with pytest.raises(Exception, match=f"{n}: NaN is not valid JSON"):
            bad.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "utf-16", "shift_jis", "cp500", "utf-8-sig", "utf-7", "iso2022_jp"])
def test_lines_of_encodings(spark, tmp_path, encoding):
    value = 'a\r\nb "x"\n\nc\x1cd\re' + ("\x85…\nz" if encoding in ("utf-16", "utf-8-sig", "utf-7") else "\x85z" if encoding == "latin-1" else "…" if encoding == "cp1252" else "")
    (tmp_path / "x.txt").write_bytes(value.encode(encoding))
    assert [tuple(r) for r in delimited.read_lines(spark, f"{tmp_path}/x.txt", encoding).orderBy("_ord").select("_line", "text").collect()] == list(enumerate(value.splitlines(), 1))
    (tmp_path / "empty.txt").write_bytes(b"")
    assert delimited.read_lines(spark, f"{tmp_path}/empty.txt", encoding).collect() == []


def test_lines_of_bad_bytes(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("a\nb\né".encode("cp1252"))
    with pytest.raises(Exception, match="line 3 behind byte 0: not utf-8: byte 0xe9 at offset 0"):
        delimited.read_lines(spark, f"{tmp_path}/x.txt").collect()
