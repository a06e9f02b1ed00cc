"""ARC to WARC: a converter for the legacy archive format, and the round trip of a table of pages through it.

An ARC file begins with a version block whose second line says how the header line of every record is laid out:
version 1 has URL, IP, date, type and length; version 2 adds result code, checksum, location, offset and file name. After
the header line come as many bytes as it declares. The converter reads both, and makes of each record a WARC record
with an identifier derived from its content, an ISO timestamp, a type and the payload's digest.

A table of pages is written as ARC members (even ids version 2, odd ids version 1), converted, and written as WARC files of about
`file_bytes` bytes (one record at least), each with a warcinfo record for every version of its members, in the shared folder by Spark's own text sink (a record is valid UTF-8; the line separator is the two CRLF that end a
record), so that any file system that Spark writes to will do. Then the files are read again, inflated piece by piece and parsed record by record.

Records of equal payload: the one with the largest id is the response, the others are revisits of it, which name its identifier, URL and date. Digests are grouped before anything else; payloads meet the grouped digests by a broadcast where few digests repeat and by a join,
which Spark may split where it is skewed, beyond that.

Defined results: null payload is empty; a null or unusable URL becomes urn:page:<id>; repeated rows with the largest id are
all responses; a row without id is a revisit of its group's response, or a response if no row of the group has an id;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shared_dir

# The field names of ARC header lines by version.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MOST_BROADCAST = 100_000
"""Repeated digests that are broadcast at most; about 200 bytes each."""
PIECE = 1 << 20
"""Bytes inflated at a time."""
PAGE = "X-Graphloom-Refers-To-Page"
"""Header of a revisit: the page that WARC-Refers-To names, so that reading needs no join."""


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 graphloom\n{TITLES[version]}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return " ".join(head).encode() + b"\n" + body


def arc_member(version: int, url: str, date: str, body: bytes, name: str = "-", ip: str = "0.0.0.0", kind: str = "text/html", status: str = "200") -> bytes:
    head = [url, ip, date, kind] + ([status, "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return b"\n" + " ".join(head).encode() + b"\n" + body


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block among them; ValueError where a header line or length doesn't fit."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("header line without end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("no version block")
            length = int(parts[-1])
            first = data[end + 1 : end + 1 + length].split(b"\n", 1)[0].split()
            version = int(first[0]) if first and first[0].isdigit() else 1
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        names = FIELDS[version]
        if len(parts) < len(names):
            raise ValueError("short header line")
        # Old writers left spaces in URLs: what is left over belongs to the URL.
        extra = len(parts) - len(names)
        fields = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
        length = int(fields["length"])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError("record shorter than declared")
        yield ArcRecord(version, fields, body)
        at = end + 1 + length


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or the first digits of it, as ISO time."""
    d = re.sub(r"\D", "", arc_date)[:14]
    d = d + "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; no head if the body isn't an HTTP message."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def warc_head(kind: str, headers: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


@dataclass
class Original:
    """What a revisit says of the record that it refers to."""

    page: str
    record: str
    url: str
    date: str


def identifier(rec: ArcRecord) -> str:
    """Of the WARC record that a page's ARC record becomes: from its URL, time, payload and HTTP head."""
    head, payload = split_http(rec.body)
    return record_id(rec.fields["url"], warc_date(rec.fields["date"]), digest32(payload), head.decode("utf-8", "replace"))


def convert(rec: ArcRecord, revisit_of: Original | None = None) -> bytes:
    """A WARC record, without the two CRLF that end it. revisit_of: the record that has the same payload."""
    url, date = rec.fields["url"], warc_date(rec.fields["date"])
    if url.startswith("filedesc:"):
        body = f"software: graphloom\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {rec.version}\r\n".encode()
        return warc_head("warcinfo", [("WARC-Record-ID", record_id(url, date, str(rec.version))), ("WARC-Date", date), ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], len(body)) + body
    head, payload = split_http(rec.body)
    common = [("WARC-Record-ID", identifier(rec)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", rec.fields["ip"]), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if not head:
        return warc_head("resource", [*common, ("Content-Type", rec.fields["type"])], len(payload)) + payload
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit_of is not None:
        refers = [("WARC-Refers-To", revisit_of.record), ("WARC-Refers-To-Target-URI", revisit_of.url), ("WARC-Refers-To-Date", revisit_of.date), (PAGE, revisit_of.page)]
        return warc_head("revisit", [*common, kind, ("WARC-Profile", PROFILE), *refers], len(head)) + head
    return warc_head("response", [*common, kind], len(rec.body)) + rec.body


def pieces(data: bytes) -> Iterator[bytes]:
    """Of all gzip members, PIECE bytes at a time, or of the data itself if it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + PIECE] for i in range(0, len(data), PIECE))
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            out = d.decompress(data, PIECE)
            data = d.unconsumed_tail or d.unused_data
            if out:
                yield out
            elif not data and not d.eof:
                raise ValueError("gzip member without end")


def parse_warc(parts: Iterator[bytes] | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of the pieces; what is held is one record and a piece."""
    source = iter([parts] if isinstance(parts, bytes) else parts)
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(source, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while len(held) - at < 2:
            if not more():
                if len(held) > at:
                    raise ValueError("no WARC record here")
                return
        if held[at : at + 2] == b"\r\n":
            at += 2
            continue
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("record header without end")
        if not held.startswith(b"WARC/", at):
            raise ValueError("no WARC record here")
        headers = {}
        for line in held[at:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        at, length = end + 4, int(headers["content-length"])
        while len(held) - at < length:
            if not more():
                raise ValueError("record shorter than declared")
        yield headers, bytes(held[at : at + length])
        at += length


def page_arc(page_id: int | None, url: str | None, payload: bytes, date: str) -> bytes:
    """A page as an ARC file of one version block and one record."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    if safe.startswith("filedesc:"):
        safe = f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    head += f"X-Page-Id: {page_id}\r\n\r\n" if page_id is not None else "\r\n"
    version = 1 if (page_id or 0) % 2 else 2
    return arc_version_block(version, "pages.arc", date) + arc_member(version, safe, date, head.encode() + payload, "pages.arc")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20000101000000", least_bytes: int = 0, file_bytes: int = 32 << 20) -> None:
    """Writes one WARC record a page under path; payloads of fewer than least_bytes bytes are responses all."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    key = F.sha1(F.col("payload").cast("binary"))
    # Of rows that share the largest id, the greatest URL stands for all.
    groups = rows.groupBy(key.alias("key")).agg(F.max(F.struct(F.col("id").alias("id"))).alias("m"), F.count(F.lit(1)).alias("n"), F.max_by(F.coalesce("url", F.lit("")), F.struct(F.col("id").isNotNull(), "id", F.coalesce("url", F.lit("")))).alias("keeper_url"))
    groups = groups.select("key", F.col("m.id").alias("keeper"), "keeper_url", "n").filter("n > 1 and keeper is not null").drop("n")
    if groups.count() <= MOST_BROADCAST:
        groups = F.broadcast(groups)
    rows = rows.withColumn("key", key).join(groups, "key", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    rows = rows.select("id", "url", "payload", F.when(revisit, F.col("keeper")).alias("keeper"), "keeper_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, versions = [], 0, set()
        # One row is one file: its records are parted as the sink parts rows.
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary()).cast(pa.string())], ["value"])
        for b in batches:
            for i, url, payload, keeper, keeper_url in zip(*(b.column(c) for c in range(5)), strict=True):
                body = payload.as_py().encode()
                about, page = parse_arc(page_arc(i.as_py(), url.as_py(), body, date))
                original = None
                if (k := keeper.as_py()) is not None:
                    _, first = parse_arc(page_arc(k, keeper_url.as_py(), body, date))
                    original = Original(str(k), identifier(first), first.fields["url"], warc_date(first.fields["date"]))
                record = convert(page, original)
                if held and size + len(record) > file_bytes:
                    yield packed()
                    held, size, versions = [], 0, set()
                if about.version not in versions:
                    versions.add(about.version)
                    held.append(convert(about))
                held.append(record)
                size += len(record)
        if held:
            yield packed()

    records = rows.mapInArrow(run, "value string")
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


READ = "record_id string, record_type string, date string, uri string, payload_digest string, page_id long, payload_bytes long, refers_to long"


def read_archives(spark, path: str) -> DataFrame:
    """One row a record of the WARC files under path, warcinfo records among them; a revisit's payload length is that of its HTTP head."""
    names, kinds = [x.split()[0] for x in READ.split(", ")], [pa.string()] * 5 + [pa.int64()] * 3

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind = h["warc-type"]
        if kind == "warcinfo":
            return h["warc-record-id"], kind, h["warc-date"], None, None, None, len(block), None
        head, payload = split_http(block)
        http = dict(x.lower().split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and digest != digest32(payload):
            raise ValueError(f"digest of {h['warc-record-id']}")
        size = int(http["content-length"]) if kind == "revisit" else len(payload)
        refers = h.get(PAGE.lower())
        return h["warc-record-id"], kind, h["warc-date"], h.get("warc-target-uri"), digest, int(http["x-page-id"]) if "x-page-id" in http else None, size, int(refers) if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [row(h, block) for h, block in parse_warc(pieces(content.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to WARC files in the shared folder and returns the pages' records as they are read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path).filter("record_type <> 'warcinfo'")
