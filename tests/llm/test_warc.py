"""Archives: exact round trips, legacy headers, revisits."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from tabloom.llm import queries, warc


def brute(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        leader = max(ids) if len(data) >= 1000 and len(groups[data]) > 1 and ids else i
        revisit = leader != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=repr)


def test_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op7_warc(spark, sf).collect()), key=repr) == brute(rows)


def test_edges(spark):
    big = "x" * 1500
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "", "short"), (6, "v", "short"), (None, "w", big), (7, "é\n", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 200), (8, "z", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, value string, same string").repartition(3)
    found = warc.archived(df).collect()
    assert sorted(((r["source_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_source_id"]) for r in found), key=repr) == brute(rows)
    by_id = {r["record_id"]: r["source_id"] for r in found}
    for r in found:
        if r["record_type"] == "revisit":
            assert by_id[r["refers_to"]] == r["refers_to_source_id"]
        else:
            html = next(h for i, _, h in rows if i == r["source_id"] and (i is not None or True))
            assert bytes(r["payload"]) == (html or "").encode()


def test_large_pages(spark):
    """Pages of a megabyte, whose payloads hold what ends a record, even at their own ends."""
    rows = [(i, f"http://a/{i}", (f"page {i} " + "x\r\n\r\ny\r\r\n" * 90_000) + "\r\n" * (i % 4)) for i in range(24)]
    found = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert {r["source_id"]: bytes(r["payload"]).decode() for r in found} == {i: h for i, _, h in rows}
    assert {r["record_type"] for r in found} == {"response"}


def test_runs():
    assert list(warc._runs([1] * 130)) == [range(0, 64), range(64, 128), range(128, 130)]
    assert list(warc._runs([warc.AT_MOST, warc.AT_MOST, 1])) == [range(0, 1), range(1, 2), range(2, 3)] and list(warc._runs([])) == []


def test_no_rows(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_round_trip(version):
    blocks = [("http://a/ b", "20010203", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore"), ("dns:x", "20010203040506", "text/dns", b"\n1 2 3\n"), ("http://e/", "2001", "text/plain", b"")]
    records = list(warc.arc_records(warc.arc_file(blocks, version)))
    assert [r.block for r in records] == [b[3] for b in blocks]
    assert {r.version for r in records} == {str(version)}
    data = b"".join(warc.to_warc(r) + warc.END for r in records)
    back = list(warc.warc_records(data))
    assert [r.block for r in back] == [b[3] for b in blocks]
    assert [r.fields["WARC-Type"] for r in back] == ["response", "resource", "resource"]
    assert [r.fields["WARC-Date"] for r in back] == ["2001-02-03T00:00:00Z", "2001-02-03T04:05:06Z", "2001-01-01T00:00:00Z"]
    assert back[0].fields["WARC-Payload-Digest"] == warc.sha1(b"body\n\nmore")
    assert len({r.fields["WARC-Record-ID"] for r in back}) == 3


def test_broken_archives():
    whole = warc.arc_file([("http://a/", "20010203", "text/html", b"12345")])
    with pytest.raises(warc.ArchiveError):
        list(warc.arc_records(whole[:-4]))
    record = warc.to_warc(next(warc.arc_records(whole))) + warc.END
    with pytest.raises(warc.ArchiveError):
        list(warc.warc_records(record.replace(b"12345", b"12346")))
    with pytest.raises(warc.ArchiveError):
        list(warc.warc_records(record[:-2]))
