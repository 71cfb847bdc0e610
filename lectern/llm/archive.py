"""WARC archives, and a converter for the older ARC format.

ARC records are read by the declared lengths of their header lines, whose fields the version
block of the file names (versions 1 and 2). The converter makes what ARC lacks: record ids (a
UUID of the archive's own facts, so that a repeated task writes the same), timestamps in the
newer notation, record types, and digests. Files are written and read through Spark's own
sources, so any store that Spark reaches will do.

Defined results: a null page is an empty payload; a null url is `about:blank`, and spaces and
control characters of urls are percent-encoded; an ARC record that ends before its declared
length is converted with WARC-Truncated; every row is one record, also where an id repeats: rows
with the same id and payload are both responses (or both revisits) with one record id, rows with
the same id and other payloads are told apart by their digests; a null id is written without one
and always a response; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, slices

# The fields of an ARC header line by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
#: Payloads below this size are always stored in full.
LEAST = 100
_SAFE = re.compile(rb"[\x00-\x20\x7f]")


@dataclass
class Record:
    """Headers and block of an archived record."""

    headers: dict[str, str]
    block: bytes
    truncated: bool = False


def _url(url: bytes | None) -> bytes:
    return _SAFE.sub(lambda m: b"%%%02X" % m[0][0], url or b"about:blank") or b"about:blank"


# --- ARC -----------------------------------------------------------------------------------


def write_arc(name: str, records: Iterator[tuple[bytes, str, str, bytes]], version: str = "1") -> bytes:
    """An ARC file of (url, fourteen-digit date, content type, network document)."""
    fields = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}[f] for f in ARC_FIELDS[version])
    head = f"{version} 0 Reserved\n{fields}\n".encode()
    extra = b" 200 - - 0 " + name.encode() if version == "2" else b""
    out = [b"filedesc://%s 0.0.0.0 19960101000000 text/plain%s %d\n%s\n" % (name.encode(), extra, len(head), head)]
    at = len(out[0])
    for url, date, kind, document in records:
        more = b"" if version == "1" else b" 200 %s - %d %s" % (hashlib.md5(document).hexdigest().encode(), at, name.encode())
        out.append(b"%s 0.0.0.0 %s %s%s %d\n%s\n" % (_url(url), date.encode(), kind.encode(), more, len(document), document))
        at += len(out[-1])
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[Record]:
    """Records of an ARC file, the version block left out. Raises ValueError on a bad header line."""
    at, fields = 0, ARC_FIELDS["1"]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # what separates records
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        parts = line.split(b" ")
        start = end + 1
        if line.startswith(b"filedesc://"):
            size = int(parts[-1])
            version = data[start : start + 1].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = ARC_FIELDS[version]
            at = start + size
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields at byte {at}, not {len(fields)}")
        headers = dict(zip(fields, (p.decode("utf-8", "replace") for p in parts)))
        size = int(headers["length"])
        block = data[start : start + size]
        yield Record(headers, block, len(block) < size)
        at = start + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of a network document; no head where it isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


# --- WARC ----------------------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    """The fourteen digits of ARC (shorter ones filled up) as an ISO timestamp."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*facts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, facts)))}>"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A record without the last of its four closing bytes' line end (the writer adds it)."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n%sContent-Length: %d\r\n\r\n%s\r\n" % (lines.encode(), len(block), block)


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def convert_arc(data: bytes, refers: Callable[[str | None, str], int | None] = lambda page, digest: None) -> Iterator[bytes]:
    """WARC records for the records of an ARC file.

    refers: for the X-Page-Id and payload digest of a record whose payload another page's record
    holds, that page's id; such records become revisits without payload.
    """
    for r in read_arc(data):
        head, payload = split_http(r.block)
        digest = hashlib.sha256(payload).hexdigest()
        page = _header(head, rb"X-Page-Id")
        date = warc_date(r.headers["date"])
        first = refers(page, digest)
        other = first is not None
        kind = "revisit" if other else "response" if head else "resource"
        own = record_id("page", page, digest) if page is not None else record_id(r.headers["url"], date, digest)
        headers = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": r.headers["url"], "WARC-IP-Address": r.headers["ip"], "Content-Type": "application/http;msgtype=response" if head else r.headers["type"], "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(head if other else r.block).hexdigest()}"}
        if other:
            headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id("page", first, digest), "X-Refers-To-Page-Id": str(first), "X-Payload-Length": str(len(payload))}
        if r.truncated:
            headers["WARC-Truncated"] = "length"
        yield warc_record(headers, head if other else r.block)


class _Stream:
    """Bytes of a file, decompressed as they are asked for (any number of gzip members)."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.zip is None:
            self.buffer += piece
            return True
        rest = bytes(piece)
        while rest:
            self.buffer += self.zip.decompress(rest)
            rest = self.zip.unused_data
            if rest:
                self.zip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:k])
        del self.buffer[: k + len(mark)]
        return out

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_warc(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, gzipped or not, by their declared lengths."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = stream.read(size)
        yield Record(headers, block, len(block) < size)
        stream.read(4)


# --- tables --------------------------------------------------------------------------------


def first_holders(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """digest and first: payloads of `least` bytes or more that several rows hold, with the smallest page_id.

    Partial minima per digest: a payload that a third of all pages share stays one row per task.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    keys = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    return keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")


def write_warc(pages: DataFrame, path: str, work: Workspace, least: int = LEAST) -> None:
    """Write pages (page_id, url, html) to gzipped WARC files through an ARC file for each batch."""
    # Written, so that both sides of a sort-merge join are plain exchanges: a hot digest can be split.
    holders = work.save(first_holders(pages, least))
    body = F.coalesce("html", F.lit("")).cast("binary")
    # Small payloads meet no holder; keys of their own spread them.
    key = F.when(F.octet_length("html") >= least, F.sha2("html", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = pages.select("page_id", F.col("url").cast("binary").alias("url"), body.alias("html")).withColumn("digest", key).join(holders, "digest", "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.struct("digest", "first")).alias("refers_to"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(slices(batches, "html", 2 << 20)):
            cols = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "refers_to")}
            first = {(str(p), r["digest"]): r["first"] for p, r in zip(cols["page_id"], cols["refers_to"]) if r is not None}
            heads = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (b"" if p is None else b"X-Page-Id: %d\r\n" % p, len(h)) for p, h in zip(cols["page_id"], cols["html"]))
            arc = write_arc("pages.arc", ((u, "20240101000000", "text/html", head + h) for u, head, h in zip(cols["url"], heads, cols["html"])), "12"[k % 2])
            made = list(convert_arc(arc, lambda page, digest: first.get((page, digest))))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    out = rows.mapInArrow(convert, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_warc_table(spark, path: str) -> DataFrame:
    """One row per record of the WARC files under path: ids, types, payload facts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for r in read_warc(data.as_buffer().to_pybytes()):
                    h = r.headers
                    head, payload = split_http(r.block)
                    page = _header(head, rb"X-Page-Id")
                    stored = h["WARC-Type"] != "revisit"
                    digest = hashlib.sha256(payload).hexdigest() if stored else h["WARC-Payload-Digest"].partition(":")[2]
                    size = len(payload) if stored else int(h["X-Payload-Length"])
                    refers = None if stored else int(h["X-Refers-To-Page-Id"])
                    rows.append((None if page is None else int(page), size, digest, h["WARC-Type"], refers, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write every page to WARC files in the shared folder, and read the files back."""
    work = Workspace(pages.sparkSession, "archive")
    path = work.path()
    write_warc(pages, path, work, least)
    return read_warc_table(pages.sparkSession, path)
