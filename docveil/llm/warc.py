"""WARC archives as chunked record tables.

An archive is a table of rows (archive, record_id, chunk_no, data, running_crc32). The data of an archive's rows, in order,
are the bytes of a .warc.gz file with one gzip member a record. A payload never has to be in memory as one record:
the writer compresses it slice by slice into chunks, each with the checksum of the record so far, and the reader
decompresses chunk by chunk and carries the payload's SHA-1 along.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import partitions_for, staged, table

CHUNK = 1 << 18
SLICE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive int, position bigint, record_id string, chunk_no int, data binary, running_crc32 bigint"


class WarcError(ValueError):
    pass


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def head(record_id: str, kind: str, url: str | None, digest: str, size: int, refers_to: str | None, block: int) -> bytes:
    """A record's header, up to its empty line. Characters that would end a line are escaped in the url."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(record_id: str, url: str | None, payload: bytes | memoryview, refers_to: str | None) -> Iterator[bytes]:
    """A record's gzip member in pieces: a response, or a revisit of `refers_to` without its payload."""
    view, sha = memoryview(payload), hashlib.sha1()
    for i in range(0, len(view), SLICE):
        sha.update(view[i : i + SLICE])
    size = len(view)
    http = http_head(size)
    if refers_to is not None:
        view = view[:0]
    zip_ = zlib.compressobj(4, zlib.DEFLATED, 31)
    kind = "response" if refers_to is None else "revisit"
    yield zip_.compress(head(record_id, kind, url, base32_sha1(sha.digest()), size, refers_to, len(http) + len(view)) + http)
    for i in range(0, len(view), SLICE):
        yield zip_.compress(view[i : i + SLICE])
    yield zip_.compress(b"\r\n\r\n") + zip_.flush()


def chunks(pieces: Iterator[bytes], size: int = CHUNK) -> Iterator[bytes]:
    """Pieces joined and cut again into chunks of `size` bytes; the last one is shorter."""
    kept = bytearray()
    for p in pieces:
        kept += p
        while len(kept) > size:
            yield bytes(kept[:size])
            del kept[:size]
    yield bytes(kept)


class Reader:
    """Reads one record chunk by chunk, holding no more than its headers and one decompressed slice."""

    def __init__(self, record_id: str):
        self.record_id, self.zip = record_id, zlib.decompressobj(31)
        self.crc, self.next, self.start = 0, 0, b""
        self.fields: dict[str, str] | None = None
        self.left, self.http, self.sha, self.size = 0, False, hashlib.sha1(), 0

    def feed(self, chunk_no: int, data: bytes, crc: int) -> None:
        self.crc = zlib.crc32(data, self.crc)
        if chunk_no != self.next or crc != self.crc:
            raise WarcError(f"{self.record_id}: chunk {self.next} is missing or damaged")
        self.next += 1
        while data:
            self._take(self.zip.decompress(data, SLICE))
            data = self.zip.unconsumed_tail

    def _take(self, raw: bytes) -> None:
        if self.fields is None or not self.http:
            self.start += raw
            while (not self.http) and (at := self.start.find(b"\r\n\r\n")) >= 0:
                part, self.start = self.start[:at], self.start[at + 4 :]
                if self.fields is None:
                    self.fields = dict(x.split(": ", 1) for x in part.decode().split("\r\n")[1:])
                    self.left = int(self.fields["Content-Length"])
                else:
                    self.left -= at + 4
                    self.http = True
            if not self.http:
                return
            raw, self.start = self.start, b""
        part = raw[: self.left]
        self.sha.update(part)
        self.size += len(part)
        self.left -= len(part)

    def end(self) -> tuple[str, str, int, str, str | None]:
        """(record id, type, payload bytes, payload digest, refers to), once the gzip member has ended."""
        self._take(self.zip.flush())
        if not self.zip.eof or not self.http or self.left:
            raise WarcError(f"{self.record_id}: the record is cut off")
        f = self.fields
        digest, size = base32_sha1(self.sha.digest()), self.size
        said = f["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = f.get("WARC-Refers-To")
        if f["WARC-Type"] == "revisit":
            digest, size = said, int(f["X-Payload-Length"])
        elif digest != said:
            raise WarcError(f"{self.record_id}: the payload's digest differs")
        return f["WARC-Record-ID"][1:-1], f["WARC-Type"], size, digest, refers and refers[1:-1]


def name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(record_id: str) -> int | None:
    number = record_id.rpartition(":")[2]
    return int(number) if number else None


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) as a chunked record table in the shared folder.

    Of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response and the
    others revisit it; rows that repeat that page_id are responses too. Rows without a page_id revisit it as well, or are
    all responses if none of them has one. Null html is an empty payload.

    A payload is hashed and compressed slice by slice out of the batch that Spark hands over, never copied as a whole.
    """
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.withColumn("digest", F.sha1("payload"))
    first = (
        keyed.where(F.length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # written first, so that its size is known when the join is planned
    plan = keyed.join(staged(first, "repeated"), "digest", "left").select("page_id", "url", "payload", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, at, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, first_id = (batch.column(c)[i].as_py() for c in (0, 1, 3))
                payload = memoryview(batch.column(2)[i].as_buffer())
                refers = name(first_id) if first_id is not None and first_id != page else None
                key, crc = f"{archive}/{at}", 0
                for k, data in enumerate(chunks(record(name(page), url, payload, refers))):
                    crc = zlib.crc32(data, crc)
                    rows.append((archive, at, key, k, data, crc))
                    held += len(data)
                    if held > 1 << 22:
                        yield out(rows)
                        rows, held = [], 0
                at += 1
        if rows:
            yield out(rows)

    kinds = pa.schema([("archive", pa.int32()), ("position", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("running_crc32", pa.int64())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return staged(plan.mapInArrow(run, CHUNKS), "warc")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of a chunked record table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

        def close() -> None:
            record_id, kind, size, digest, refers = reader.end()
            rows.append((page_of(record_id), size, digest, kind, refers and page_of(refers)))

        for batch in batches:
            for i in range(batch.num_rows):
                record_id, chunk_no, data, crc = (c[i].as_py() for c in batch.columns)
                if reader is None or reader.record_id != record_id:
                    if reader is not None:
                        close()
                    reader = Reader(record_id)
                reader.feed(chunk_no, data, crc)
            if len(rows) > 5000:
                yield out()
                rows.clear()
        if reader is not None:
            close()
        if rows:
            yield out()

    return (
        archives.select("record_id", "chunk_no", "data", "running_crc32")
        .repartition(partitions_for(archives), "record_id")
        .sortWithinPartitions("record_id", "chunk_no")
        .mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages")))
