"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of bounded size. A bundle is a file of frames,
followed by an index of its records in a skippable frame and by the footer seek table of the
seekable format, so any record is read by fetching one frame. The manifest maps record
identifiers to bundle, frame and the offset inside the frame's content.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
identifier is a response and the others revisit it. A null payload is an empty one. Identical
rows that share the largest identifier are all responses; a record with a null identifier is
a revisit where an equal payload has an identifier, else a response. Bundles are named by
task attempt and only those in the manifest count, so a repeated task does no harm.

A response's block is an HTTP response with the payload, a revisit's block that response's head
alone, which states the payload's length. Record identifiers are UUIDs that hold the integer
identifier; addresses are escaped as URIs, and a record without one has its own URN as target.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote
from uuid import UUID

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder, small_batches

#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = pa.schema([("bundle", pa.string()), ("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("bytes", pa.int32())])
RECORD = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])


#: Ours, in the freely usable bits of a version 8 UUID.
_OWN = 0x706F72657769


def _urn(record_id: int | None) -> str:
    """A UUID of 48 own bits, the version, whether there is an identifier, and the identifier's 64 bits around the variant."""
    bits = (record_id or 0) & ((1 << 64) - 1)
    flags = (record_id is None) << 2 | bits >> 62
    return f"urn:uuid:{UUID(int=_OWN << 80 | 8 << 76 | flags << 64 | 2 << 62 | bits & (1 << 62) - 1)}"


def _number(urn: str) -> int | None:
    value = UUID(urn).int
    flags, bits = value >> 64 & 7, (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return None if flags >> 2 else bits - (bits >> 63 << 64)


def record_bytes(record_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC 1.1 record; ``date`` is in UTC, as YYYY-MM-DDThh:mm:ssZ."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_urn(record_id)}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + (_urn(record_id) if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~")),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_records(content: bytes, verify: bool = True) -> Iterator[dict]:
    """The records of one frame's content, each with its offset."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size, block = int(fields["Content-Length"]), end + 4
        body = content.index(b"\r\n\r\n", block) + 4
        payload, revisit = content[body : block + size], fields["WARC-Type"] == "revisit"
        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", content[block:body])[1])
        digest, own = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Record-ID"][1:-1]
        if verify and not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"record {own}: its payload doesn't match its length and digest")
        yield {
            "id": _number(own),
            "uri": None if fields["WARC-Target-URI"] == own else fields["WARC-Target-URI"],
            "record_type": fields["WARC-Type"],
            "refers_to": _number(fields["WARC-Refers-To"][1:-1]) if revisit else None,
            "payload_digest": digest,
            "payload_bytes": length,
            "payload": None if revisit else payload,
            "offset": at,
        }
        at = block + size + 4


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, also by the schemes that Spark has for object stores."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class BundleWriter:
    """Frames of about ``frame_bytes`` of content; the bundle is kept in memory up to its bound."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.compress = frame_bytes, zstandard.ZstdCompressor(level=3).compress
        self.data, self.table, self.index, self.frame = bytearray(), [], [], bytearray()

    def add(self, record_id: int | None, record: bytes) -> None:
        self.index.append((record_id, len(self.table), len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = self.compress(bytes(self.frame))
            self.table.append((len(packed), len(self.frame)))
            self.data += packed
            self.frame = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        index = self.compress(json.dumps(self.index).encode())
        self.data += struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        table = [*self.table, (len(index) + 8, 0)]
        body = b"".join(struct.pack("<II", *e) for e in table) + struct.pack("<IBI", len(table), 0, SEEKABLE_MAGIC)
        return bytes(self.data + struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)


class BundleReader:
    """Random access by the footer: only the table and the frames asked for are read."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        source.seek(size - 9 - n * width)
        table = source.read(n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, full = struct.unpack_from("<II", table, i * width)
            if full:
                self.frames.append((at, packed, full))
            at += packed

    def content(self, frame: int) -> bytes:
        at, packed, full = self.frames[frame]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=full)

    def record(self, frame: int, offset: int, size: int) -> dict:
        return next(parse_records(self.content(frame)[offset : offset + size]))


def _typed(pages: DataFrame, id_col: str, payload: str, uri: str, min_bytes: int) -> DataFrame:
    """Each record with its payload's digest and the response that its payload belongs to."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    again = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select("digest", "keeper"), "warc-repeated")
    if again.count() <= 1_000_000:  # 28 bytes each; more are joined by a shuffle
        again = F.broadcast(again)
    typed = rows.join(again, "digest", "left")
    return typed.withColumn("revisit", F.coalesce(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.lit(False)))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", payload: str = "html", uri: str = "url", min_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, date: datetime | None = None) -> DataFrame:
    """Write all records below ``folder`` (any file system that pyarrow opens), as of ``date`` or now; returns the manifest."""
    written = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    small_batches(pages.sparkSession, 500)

    def run(batches):
        context = TaskContext.get()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        number, writer = 0, BundleWriter(frame_bytes)

        def flush():
            name = f"{context.stageId()}-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
            data = writer.finish()
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            ids, frames, offsets, sizes = (list(c) for c in zip(*writer.index, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(ids)), *(pa.array(v, t) for v, t in zip((ids, frames, offsets, sizes), MANIFEST.types[1:], strict=True))], schema=MANIFEST)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record_id, address, body, digest, keeper, revisit = r
                writer.add(record_id, record_bytes(record_id, address, body, base64.b32encode(digest).decode(), keeper, revisit, written))
                if len(writer.data) >= bundle_bytes:
                    yield flush()
                    number, writer = number + 1, BundleWriter(frame_bytes)
        if writer.index:
            yield flush()

    typed = _typed(pages, id_col, payload, uri, min_bytes).select("id", "uri", "payload", "digest", "keeper", "revisit")
    return materialize(typed.mapInArrow(run, "bundle string, id long, frame int, offset int, bytes int"), "warc-manifest")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles in a manifest, in RECORD's columns; payloads of revisits are null."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = _store(path)
                with store.open_input_file(local) as source:
                    reader = BundleReader(source)
                    for frame in range(len(reader.frames)):
                        rows = [r | {"bundle": path, "frame": frame} for r in parse_records(reader.content(frame))]
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    schema = "id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, bundle string, frame int, offset int"
    paths = bundles.select("bundle").distinct()
    # a task for each bundle: paths are so few bytes that Spark would put them all into one
    return paths.repartition(min(max(1, paths.count()), 20_000)).mapInArrow(run, schema)


def with_payloads(records: DataFrame) -> DataFrame:
    """The records with each revisit's payload, taken from the response that it refers to.

    A revisit whose response is not among the records, or has another digest, keeps a null payload.
    Only identifiers and digests of revisits meet the responses they name, and responses that none
    names are not joined at all; many revisits of one response are left to Spark's skew handling.
    """
    revisits = records.where("record_type = 'revisit'")
    responses = records.where("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("id")).distinct(), "id", "left_semi")
    # of responses with one identifier, one stands for all with its digest
    named = responses.groupBy(F.col("id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("__payload"))
    found = revisits.drop("payload").join(named, ["refers_to", "payload_digest"], "left").withColumnRenamed("__payload", "payload")
    return records.where("record_type = 'response'").unionByName(found.select(*records.columns))


def fetch(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the records whose identifier is in ``ids`` (column ``id``), each by reading one frame."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, frame, offset, size in zip(*(batch.column(k).to_pylist() for k in ("bundle", "frame", "offset", "bytes")), strict=True):
                store, local = _store(path)
                with store.open_input_file(local) as source:
                    rows.append(BundleReader(source).record(frame, offset, size) | {"bundle": path, "frame": frame, "offset": offset})
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    wanted = manifest.join(ids.select("id").distinct(), "id", "left_semi")
    return wanted.mapInArrow(run, "id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, bundle string, frame int, offset int")


def archive_folder(spark) -> str:
    """A new folder for bundles under the shared root, as a URI."""
    path = new_folder(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
