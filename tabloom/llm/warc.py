"""WARC: a converter of legacy ARC archives, and archives that Spark writes and reads.

An ARC file begins with a version block whose last line names the fields of the
header lines that follow; each header line declares its record's length.  The
converter reads both versions of the format and synthesises what WARC asks for:
record identifiers, timestamps, types and digests.

Archives are written by Spark's text sink, a record to a row, into the shared folder,
so that a task that is lost is run again and only committed files are read.  They are
read back as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared

V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tabloom:arc")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """A header line, a length or a digest is not as declared."""


@dataclass
class Record:
    """A record of an archive: header fields by name, and its block."""

    fields: dict[str, str]
    block: bytes
    version: str = "1"
    extra: dict[str, str] = field(default_factory=dict)


def arc_file(records: list[tuple[str, str, str, bytes]], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of (url, date, content type, block)."""
    names = V1 if version == 1 else V2
    head = f"{version} 0 tabloom\n{' '.join(names)}\n\n".encode()
    out = [_arc_line(names, f"filedesc://{name}", date, "text/plain", head, name), head, b"\n"]
    for url, day, kind, block in records:
        out += [_arc_line(names, url, day, kind, block, name), block, b"\n"]
    return b"".join(out)


def _arc_line(names: tuple[str, ...], url: str, date: str, kind: str, block: bytes, name: str) -> bytes:
    safe = "".join(f"%{ord(c):02X}" if c in " \t\r\n\v\f" else c for c in url) or "about:blank"
    value = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return (" ".join(value[n] for n in names) + "\n").encode()


def arc_records(data: bytes) -> Iterator[Record]:
    """The records of an ARC file behind its version block, by header lines and declared lengths."""
    at, names, version = 0, V1, "1"
    first = True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no end of the header line at byte {at}")
        parts = data[at:end].decode().rstrip("\r").split(" ")
        if len(parts) < len(names) and not first or len(parts) < 2 or not parts[-1].isdigit():
            raise ArchiveError(f"bad header line at byte {at}: {data[at:end][:80]!r}")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ArchiveError(f"record at byte {at} declares {length} bytes; {len(block)} are there")
        at = end + 1 + length
        if first and parts[0].startswith("filedesc:"):
            lines = block.decode().split("\n")
            version = lines[0].split(" ")[0]
            if version not in ("1", "2"):
                raise ArchiveError(f"unknown version {version!r}")
            names = tuple(lines[1].split()) if len(lines) > 1 and lines[1].strip() else (V1 if version == "1" else V2)
        else:
            # spaces in a legacy URL: what the other fields leave over at the front
            over = len(parts) - len(names)
            parts = ["%20".join(parts[: over + 1]), *parts[over + 1 :]]
            yield Record(dict(zip(names, parts)), block, version)
        first = False


def http_payload(block: bytes) -> bytes:
    """What follows the HTTP header, or all of a block without one."""
    if not block.startswith(b"HTTP/"):
        return block
    at = block.find(END)
    return block[at + 4 :] if at >= 0 else block


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """14 digits (shorter dates are filled up) as a WARC timestamp."""
    d = date + "00000101000000"[len(date) :] if len(date) < 14 else date[:14]
    if not d.isdigit():
        raise ArchiveError(f"bad date {date!r}")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(record: Record, name: str = "") -> str:
    """The same identifier whenever the same record is converted."""
    f = record.fields
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{name} {f['URL']} {f['Archive-date']} {len(record.block)}')}>"


def to_warc(record: Record, name: str = "", refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record (without the two line ends behind it) of an ARC record.

    An HTTP answer becomes a response, anything else a resource; with refers_to, a
    revisit that holds the HTTP header alone.
    """
    f, block = record.fields, record.block
    is_http = block.startswith(b"HTTP/")
    payload = http_payload(block)
    kind, content = ("response", "application/http; msgtype=response") if is_http else ("resource", f["Content-type"] or "application/octet-stream")
    if refers_to is not None:
        kind = "revisit"
        block = block[: len(block) - len(payload)] if is_http else b""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(record, name), "WARC-Date": warc_date(f["Archive-date"]), "WARC-Target-URI": f["URL"],
        "WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": sha1(payload), "WARC-Block-Digest": sha1(block), "Content-Type": content,
    }
    if f["IP-address"] in ("0.0.0.0", "-", ""):
        del head["WARC-IP-Address"]
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    head |= extra or {}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def warc_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, by declared lengths; digests of blocks are checked."""
    return streamed_records(iter([data]), b"")


def streamed_records(parts: Iterator[bytes], between: bytes = END) -> Iterator[Record]:
    """The records of archives that come in parts with ``between`` left out after each; one record is held at a time."""
    held = bytearray()

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
            held.extend(between)
        return part is not None

    while True:
        while not (lead := len(held) - len(held.lstrip(b"\r\n"))) < len(held):
            held.clear()
            if not more():
                return
        del held[:lead]
        while (end := held.find(END)) < 0 and more():
            pass
        if end < 0 or not held.startswith(b"WARC/"):
            raise ArchiveError(f"no record at byte 0 of {bytes(held[:80])!r}")
        lines = held[:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        to = end + 4 + int(fields["Content-Length"])
        while len(held) < to + 4 and more():
            pass
        if held[to : to + 4] != END:
            raise ArchiveError(f"the record {fields.get('WARC-Record-ID')} is cut off")
        block = bytes(held[end + 4 : to])
        if fields.get("WARC-Block-Digest") not in (None, sha1(block)):
            raise ArchiveError(f"the record {fields.get('WARC-Record-ID')} has another digest")
        del held[: to + 4]
        yield Record(fields, block, lines[0].removeprefix("WARC/"))


def _name(page: int | None) -> str:
    return "" if page is None else str(page)


#: Records and bytes of payload of a legacy file that is made and converted at once.
AT_ONCE, AT_MOST = 64, 4_000_000


def _runs(sizes: list[int]) -> Iterator[range]:
    """Rows in a row that are converted at once."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == AT_ONCE or total + size > AT_MOST):
            yield range(first, i)
            first, total = i, 0
        total += size
    if sizes:
        yield range(first, len(sizes))


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as a legacy record, converted."""
    for batch in batches:
        ids, urls, leaders, leader_urls = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        texts = batch.column(2).cast(pa.binary())
        sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
        for version, run in enumerate(_runs(sizes)):
            blocks = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(t) + t for t in (texts[i].as_py() or b"" for i in run)]
            legacy = arc_file([(urls[i] or "", "20240101000000", "text/html", b) for i, b in zip(run, blocks)], version=1 + version % 2)
            out = []
            for record, i in zip(arc_records(legacy), run, strict=True):
                page, leader = ids[i], leaders[i]
                extra = {} if page is None else {"X-Source-Id": str(page)}
                to = None
                if leader is not None:
                    extra["X-Refers-To-Source-Id"] = str(leader)
                    target = next(arc_records(_arc_line(V1, leader_urls[i] or "", "20240101000000", "text/html", record.block, "") + record.block))
                    to = record_id(target, _name(leader))
                out.append(to_warc(record, _name(page), to, extra))
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], ["value"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source_id", "record_id", "url", "date", "record_type", "refers_to", "refers_to_source_id", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows, volume = [], 0
    for r in streamed_records(x.as_py() for batch in batches for x in batch.column(0)):
        f = r.fields
        payload = http_payload(r.block)
        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = len(payload)
        if f["WARC-Type"] == "revisit":
            head = dict(x.split(": ", 1) for x in r.block.decode().split("\r\n")[1:] if ": " in x)
            size, payload = int(head.get("Content-Length", 0)), None
        elif hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError(f"the payload of {f['WARC-Record-ID']} has another digest")
        number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
        rows.append((number("X-Source-Id"), f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Type"], f.get("WARC-Refers-To"), number("X-Refers-To-Source-Id"), digest, size, payload))
        volume += len(r.block)
        if volume > AT_MOST or len(rows) == 4096:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows, volume = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


PARSED = "source_id long, record_id string, url string, date string, record_type string, refers_to string, refers_to_source_id long, payload_digest string, payload_bytes long, payload binary"


def write_archives(pages: DataFrame, path: str, least: int = 1000, per_file: int = 4000) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files under path.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest
    page_id is the response; the others are revisits that refer to it.

    A null html is an empty payload; a null page_id is never what others refer to
    and is itself a revisit if an equal payload has an id; a null url is
    about:blank; rows with the largest page_id are all responses; an empty table
    writes no record; other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("same"))
    large = source.where(F.octet_length("html") >= least)
    leaders = large.groupBy("same").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
    leaders = leaders.select("same", F.col("top.page_id").alias("leader"), F.col("top.url").alias("leader_url"))
    joined = source.join(leaders, "same", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("leader"))
    rows = joined.select("page_id", "url", "html", F.when(other, F.col("leader")).alias("leader"), F.when(other, F.col("leader_url")).alias("leader_url"))
    records = shared.mapped(rows, _convert, "value string")
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives under path, with checked digests; a revisit has no payload of its own.

    Spark's text source inflates the archives as a stream and cuts them at the bytes that
    end a record; what it cuts within a payload is put together again by declared
    lengths, so that a task holds a record and a batch, whatever an archive's size.
    """
    parts = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(path)
    return shared.mapped(parts.select(F.col("value").cast("binary").alias("value")), _parse, PARSED)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder, and read back."""
    path = shared.place(pages.sparkSession)
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
