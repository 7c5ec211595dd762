"""Operator 2, legacy archive conversion: ARC records to WARC records, written as gzip archives and read back.

``ArcReader`` parses ARC version 1 and 2: the version block names the fields, each record's header line is split by that
list from the right of the URL, and the declared length says how many bytes follow. ``convert`` synthesises what WARC asks
for and ARC lacks: a record id (UUID 5 of URL, timestamp and digest, so that a rerun gives the same id), an ISO timestamp
from the 14 digits, the record type, and SHA-256 digests. ``WarcReader`` reads gzip members and checks lengths and digests.

``archive_pages`` does this for a table of pages: each page becomes a legacy record, is converted, and lands in an archive
of about ``ARCHIVE_BYTES``, one row of a table with a binary column in the shared folder; the result is then read from
those archives. Of records with equal payloads of at least ``REVISIT_BYTES`` the one of least page id is the response, the
others are revisits without a body that name it; smaller ones are all responses.

Defined results: null and empty html are empty payloads; a null URL is written as ``urn:page:<id>``, blanks and control
characters in URLs are percent-encoded; rows that repeat a page id with the same html are both written: the id's own
response is no revisit of itself; a null page id is never a response for others, and counts as a revisit if another page
has its payload; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.memory import tidy
from quillspan.sources.shared import materialise

ARCHIVE_BYTES, REVISIT_BYTES = 4 << 20, 100
#: ARC carries no fetch time for pages that had none; every record gets this one.
EPOCH = "19700101000000"
#: Fixed field lists of the two ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


class BrokenArchive(ValueError):
    """Bytes that are no well-formed archive."""


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


def safe_url(url: str | None, page_id: int | None) -> str:
    """A URL without bytes that would break a header line."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


def write_arc(version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file (``url, ip, 14-digit date, content type, body``) with its version block."""
    fields = ARC_FIELDS[version]
    block = f"{version} 0 quillspan\n{' '.join(fields)}\n".encode()
    head = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": EPOCH, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "pages.arc"}
    line = lambda values, body: " ".join({**values, "Archive-length": str(len(body))}[f] for f in fields).encode() + b"\n" + body
    out = [line(head, block)]
    for url, ip, date, kind, body in records:
        out.append(b"\n" + line(head | {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind}, body))
    return b"".join(out)


class ArcReader:
    """Records of an ARC file after its version block."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        end = data.index(b"\n")
        first = data[:end].decode("latin-1").split(" ")
        if not first[0].startswith("filedesc:"):
            raise BrokenArchive("no ARC version block")
        size = int(first[-1])
        lines = data[end + 1 : end + 1 + size].decode("latin-1").split("\n")
        self.version = int(lines[0].split(" ")[0])
        if self.version not in ARC_FIELDS:
            raise BrokenArchive(f"ARC version {self.version}")
        self.fields = lines[1].split(" ")
        self.at = end + 1 + size

    def __iter__(self) -> Iterator[ArcRecord]:
        data, at = self.data, self.at
        while at < len(data):
            if data[at : at + 1] == b"\n":
                at += 1
                continue
            end = data.find(b"\n", at)
            if end < 0:
                raise BrokenArchive("a header line is cut off")
            values = data[at:end].decode("latin-1").rsplit(" ", len(self.fields) - 1)
            if len(values) != len(self.fields):
                raise BrokenArchive(f"a header line of {len(values)} fields, {len(self.fields)} are declared")
            fields = dict(zip(self.fields, values, strict=True))
            size = int(fields["Archive-length"])
            if end + 1 + size > len(data):
                raise BrokenArchive("a record is shorter than declared")
            yield ArcRecord(fields, data[end + 1 : end + 1 + size])
            at = end + 1 + size


def timestamp(date: str) -> str:
    """ISO 8601 from the leading digits of an ARC date (missing parts: the earliest)."""
    digits = re.match(r"\d*", date)[0][:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def convert(record: ArcRecord, digest: str, page_id: int | None, refers_to: int | None, full_bytes: int) -> bytes:
    """One WARC 1.1 record, without compression."""
    url, date = record.fields["URL"], timestamp(record.fields["Archive-date"])
    revisit = refers_to is not None
    block = b"" if revisit else record.body
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, f'{url} {date} {digest} {page_id}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to), "X-Payload-Length": str(full_bytes)}
    head |= {"Content-Type": record.fields["Content-type"], "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip archive, lengths and digests checked."""
    while data:
        unpack = zlib.decompressobj(31)
        try:
            record = unpack.decompress(data)
        except zlib.error as broken:
            raise BrokenArchive(str(broken)) from broken
        if not unpack.eof:
            raise BrokenArchive("a gzip member is cut off")
        data = unpack.unused_data
        head, gap, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise BrokenArchive("no WARC header")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields["Content-Length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise BrokenArchive("a block's length is not as declared")
        if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise BrokenArchive("block digest")
        yield fields, block


@tidy
def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to legacy records, to WARC records, to archives."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for page_id, url, body, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "refers_to")), strict=True):
            version = 1 + (page_id or 0) % 2
            legacy = write_arc(version, [(safe_url(url, page_id), "0.0.0.0", EPOCH, "text/html", body)])
            (record,) = ArcReader(legacy)
            held.append(gzip_member(convert(record, digest, page_id, refers_to, len(body))))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["archive"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["archive"])


@tidy
def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for archive in batch.column("archive"):
            rows = []
            for fields, block in read_warc(archive.as_py()):
                digest = fields["WARC-Payload-Digest"].partition(":")[2]
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and digest != hashlib.sha256(block).hexdigest():
                    raise BrokenArchive("payload digest")
                number = lambda key: int(fields[key]) if fields.get(key) else None
                rows.append((number("X-Page-ID"), number("X-Payload-Length") if revisit else len(block), digest, fields["WARC-Type"], number("X-Refers-To-Page"), fields["WARC-Record-ID"], fields["WARC-Date"], fields["WARC-Target-URI"]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archive_pages(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``archives`` (binary column ``archive``) in the shared folder and the ``records`` read back from them."""
    taken = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    taken = taken.withColumn("digest", F.sha2("body", 256))
    # Only payloads that occur twice meet the pages again; sums of a hot payload are formed before the shuffle.
    many = taken.where(F.length("body") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    placed = taken.join(many, "digest", "left")
    placed = placed.select("page_id", "url", "body", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    archives = materialise(spark, placed.mapInArrow(_archives, "archive binary"), "archives")
    records = archives.mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")
    return archives, records
