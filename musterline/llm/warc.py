"""WARC archives of pages: one gzip member a record, read back by a sequential reader.

`write` makes an archive record of each page. Of pages with one payload (of `least` bytes or
more) the one of the smallest page_id is a `response`; the others are `revisit` records, which
hold the HTTP head alone and name that page in WARC-Refers-To. `read` streams every archive:
a member is inflated in pieces, its header lines give the length of the block, the block is
framed and hashed as it comes, and both digests are verified. The reader holds one piece of a
record, however long the record is, unless payloads are asked for; the writer holds one payload.

Which payloads occur twice is known from SHA-1 and length, grouped in Spark. Only pages whose
digest may be repeated (a bit table tells) are shuffled to meet the page they revisit; all others
are written where they are read. A payload that a third of all pages share is one row on the
other side of that join, so Spark can split its rows.

Archives are made by Spark's text writer, which every file system takes: a line is a run of gzip
members as raw bytes, and the line separator is an empty member, which gzip readers pass over.
Files are rolled at about FILE bytes; a longer record has a file that is as long as it is.

Nulls: a null html is an empty payload, a null url has no target line, a null page_id is kept (its
record is never referred to if the group has an ID). Rows that repeat page_id and payload are
each a response, if that page_id is the smallest, as nothing tells them apart. No pages give archives
without records and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.llm.bits import bit_table, member, room
from musterline.llm.tables import written

# --- fixed values: the empty gzip member (RFC 1952), and the names of WARC/1.1 fields ---
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
VERSION = "WARC/1.1"
_GZIP = 31  # zlib's window argument for gzip framing

FILE = 16 << 20
_RUN = 1 << 20
_CHUNK = 1 << 16
_STAMP = "2024-01-01T00:00:00Z"
_RECORDS = (
    "archive string, start long, record_type string, page_id long, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, problem string"
)
_SCHEMA = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string()),
])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _one_line(url: str) -> str:
    """A URL that cannot end its header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, stamp: str = _STAMP) -> bytes:
    """One record as one gzip member; with `refers_to`, a revisit that leaves the payload out."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if revisit else payload
    block = hashlib.sha1(head)
    block.update(body)
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {stamp}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{base32(block.digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(head) + len(body)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    parts = [squeeze.compress(x) for x in ("\r\n".join(lines).encode() + b"\r\n\r\n", head, body, b"\r\n\r\n")]
    return b"".join([*parts, squeeze.flush()])


def _runs(repeated, stamp: str) -> Callable:
    """Rows of concatenated members. `repeated`: the bit table of digests whose pages are left to the join, or None after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if repeated is not None:
                batch = batch.filter(pa.array(~member(repeated.value, batch.column("key").to_numpy())))
            first = batch.column("first") if "first" in batch.schema.names else None
            for k in range(batch.num_rows):
                page_id, refers_to = batch.column("page_id")[k].as_py(), None if first is None else first[k].as_py()
                held.append(record(page_id, batch.column("url")[k].as_py(), batch.column("payload")[k].as_py(), None if refers_to == page_id else refers_to, stamp))
                size += len(held[-1])
                if size >= _RUN:
                    yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["members"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["members"])

    return task


def _suspects(repeated) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(member(repeated.value, batch.column("key").to_numpy())))

    return task


def write(pages: DataFrame, folder: str, least: int = 0, stamp: str = _STAMP, file_bytes: int = FILE) -> None:
    """Archives of pages (page_id, url, html) in a new folder."""
    spark = pages.sparkSession
    text = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), text.alias("payload"),
        F.sha1(text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    ).withColumn("key", F.xxhash64("digest", "bytes"))
    groups = keyed.where(F.col("bytes") >= least).groupBy("key", "digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeats = written(groups.where("n > 1 and first is not null").drop("n"), "warc-repeats")
    repeated = spark.sparkContext.broadcast(bit_table(repeats.select("key"), room(repeats.count())))
    alone = keyed.drop("digest", "bytes").mapInArrow(_runs(repeated, stamp), "members binary")
    suspects = keyed.mapInArrow(_suspects(repeated), keyed.schema)
    met = suspects.join(repeats.select("digest", "bytes", "first"), ["digest", "bytes"], "left").select("page_id", "url", "payload", "first")
    members = alone.union(met.mapInArrow(_runs(None, stamp), "members binary"))
    (
        members.select(F.col("members").cast("string"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", max(1, file_bytes // _RUN)).text(folder)
    )


@dataclass
class _Reading:
    """What one gzip member has told so far."""

    keep: bool
    buffer: bytearray = field(default_factory=bytearray)
    fields: dict | None = None
    left: int = 0  # bytes of the block still to come
    head: bytes | None = None
    block: object = None
    body: object = None
    body_bytes: int = 0
    payload: bytearray = field(default_factory=bytearray)
    problem: str | None = None

    def take(self, data: bytes) -> None:
        if self.fields is None:
            self.buffer += data
            end = self.buffer.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split("\r\n")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not lines[0].startswith("WARC/"):
                self.problem = "no version line"
            length = self.fields.get("content-length", "")
            if not length.isdigit():
                self.problem, length = self.problem or "no length", "0"
            self.left, self.block, self.body = int(length), hashlib.sha1(), hashlib.sha1()
            data, self.buffer = bytes(self.buffer[end + 4 :]), bytearray()
        inside, behind = data[: self.left], data[self.left :]
        if inside:
            self.left -= len(inside)
            self.block.update(inside)
            if self.head is None:
                self.buffer += inside
                end = self.buffer.find(b"\r\n\r\n")
                if end >= 0:
                    self.head, inside = bytes(self.buffer[:end]), bytes(self.buffer[end + 4 :])
                    self.buffer = bytearray()
                else:
                    inside = b""
            self.body.update(inside)
            self.body_bytes += len(inside)
            if self.keep:
                self.payload += inside
        if behind:
            self.buffer += behind  # two line ends close a record

    def row(self, archive: str, start: int) -> tuple:
        fields, problem = self.fields or {}, self.problem
        kind = fields.get("warc-type")
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.head or b"")
        size = int(length[1]) if length else self.body_bytes
        if self.fields is None:
            problem = "no header"
        elif not problem and (self.left or self.head is None or bytes(self.buffer) != b"\r\n\r\n"):
            problem = "framing"
        elif not problem and fields.get("warc-block-digest", "").removeprefix("sha1:") != base32(self.block.digest()):
            problem = "block digest"
        elif not problem and kind == "response" and (told != base32(self.body.digest()) or size != self.body_bytes):
            problem = "payload digest"
        payload = bytes(self.payload) if self.keep and kind == "response" else None
        return archive, start, kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, told, _page(fields.get("warc-refers-to")), payload, problem


def records(data: memoryview, archive: str = "", payloads: bool = False) -> Iterator[tuple]:
    """The records of one archive in order, as rows of `read`; what ends too early or is no gzip is the last row."""
    at = 0
    while at < len(data):
        start, inflate, reading, seen = at, zlib.decompressobj(_GZIP), _Reading(payloads), 0
        try:
            while not inflate.eof and at < len(data):
                piece = data[at : at + _CHUNK]
                at += len(piece)
                out = inflate.decompress(piece, _CHUNK)
                while True:
                    seen += len(out)
                    reading.take(out)
                    if inflate.eof or not inflate.unconsumed_tail:
                        break
                    out = inflate.decompress(inflate.unconsumed_tail, _CHUNK)
                while not inflate.eof and len(out) == _CHUNK:  # what zlib still holds
                    out = inflate.decompress(b"", _CHUNK)
                    seen += len(out)
                    reading.take(out)
        except zlib.error as wrong:
            yield archive, start, None, None, None, None, None, None, None, f"gzip: {wrong}"
            return
        if not inflate.eof:
            yield archive, start, None, None, None, None, None, None, None, "gzip: ends too early"
            return
        at -= len(inflate.unused_data)
        if seen:
            yield reading.row(archive, start)


def _read(payloads: bool) -> Callable:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in records(memoryview(content.as_buffer()), path.as_py(), payloads):
                    rows.append(row)
                    size += 500 + len(row[8] or b"")
                    if size >= 4 * _RUN:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return task


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder: where it is, what it says of itself, and its problem, null if none.

    `payload_bytes` and `payload_digest` are those of the full payload, of revisits too; `payload` is null
    unless asked for, and for revisits (see `restored`).
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read(payloads), _RECORDS)


def restored(found: DataFrame) -> DataFrame:
    """Records of `read(payloads=True)` with the payload of the page that a revisit refers to."""
    first = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("_payload"))
    again = found.where("record_type = 'revisit'").join(first, ["refers_to", "payload_digest"], "left")
    again = again.withColumn("payload", F.col("_payload")).select(*found.columns)
    return found.where("record_type is null or record_type <> 'revisit'").unionByName(again)


def verified(found: DataFrame) -> DataFrame:
    """The records, none of which may have a problem: the first that has one ends the job."""
    told = F.concat_ws(" ", F.lit("record"), "archive", "start", F.lit(":"), "problem")
    return found.withColumn("page_id", F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(F.raise_error(told).cast("long")))
