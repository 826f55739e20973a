"""Media columns in Ogg: writing and reading physical bit streams of two multiplexed logical streams.

A payload of 8-bit samples is cut into frames; even frames go to the first logical stream and odd ones to the second.
Reading verifies every page's checksum, reassembles packets from lacing values (also over page ends), demultiplexes by
serial number, and derives timestamps from granule positions, which count the samples that end on a page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

from docveil.llm.common import table

FRAME = 192
RATE = 8000
PACKET_FRAMES = 40
#: The identification packet of each logical stream: a name, the stream's number, the streams, the frame size, the rate.
IDENTITY = struct.Struct("<8sBBHI")
NAME = b"\x01rawu8\0\0"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, BEGIN, END = 1, 2, 4
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, most significant bit first, no inversion), by zlib's on reversed bits."""
    reflected = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(REVERSED), "big")


def laced(packets: list[bytes]) -> tuple[bytes, bytes, list[int]]:
    """Lacing values and bodies of packets, and after which lacing value each packet ends."""
    lacing, ends = bytearray(), []
    for p in packets:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends.append(len(lacing))
    return bytes(lacing), b"".join(packets), ends


def pages(packets: list[bytes], granules: list[int], serial: int) -> Iterator[tuple[int, bytes]]:
    """(granule of the page, page) of one logical stream; its first packet has a page of its own."""
    sequence = 0
    for group, at in ((packets[:1], granules[:1]), (packets[1:], granules[1:])):
        lacing, body, ends = laced(group)
        start = used = 0
        while start < len(lacing):
            part = lacing[start : start + 255]
            stop = start + len(part)
            size = sum(part)
            done = [g for e, g in zip(ends, at) if start < e <= stop]
            last = stop == len(lacing) and (group is not packets[:1] and sequence > 0 or len(packets) == 1)
            kind = (CONTINUED if start and lacing[start - 1] == 255 else 0) | (BEGIN if sequence == 0 else 0) | (END if last else 0)
            granule = done[-1] if done else -1
            head = HEADER.pack(b"OggS", 0, kind, granule, serial, sequence, 0, len(part)) + part
            page = head + body[used : used + size]
            yield granule, page[:22] + struct.pack("<I", checksum(page)) + page[26:]
            start, used, sequence = stop, used + size, sequence + 1


def write(payload: bytes) -> bytes:
    """Stores samples (a positive multiple of FRAME bytes) as an Ogg bit stream."""
    if not payload or len(payload) % FRAME:
        raise OggError("the payload must be a positive multiple of a frame")
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    streams = []
    for k in (0, 1):
        data = frames[k::2].tobytes()
        size = PACKET_FRAMES * FRAME
        packets = [data[i : i + size] for i in range(0, len(data), size)]
        granules = [min(i + size, len(data)) for i in range(0, len(data), size)]
        streams.append(list(pages([IDENTITY.pack(NAME, k, 2, FRAME, RATE), *packets], [0, *granules], k + 1)))
    firsts = [s[0][1] for s in streams]
    # pages follow in order of time; one on which no packet ends stays before the next of its stream
    rest = []
    for k, s in enumerate(streams):
        known = 0
        for i, (g, page) in enumerate(s[1:]):
            known = g if g >= 0 else known
            rest.append((known, k, i, page))
    return b"".join([*firsts, *(p for *_, p in sorted(rest, key=lambda x: x[:3]))])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    sequence: int = 0
    ended: bool = False


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of pages. Damage raises OggError."""
    streams: dict[int, Stream] = {}
    at = count = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError("cut off in a page header")
        magic, version, kind, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should start")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        body = at + HEADER.size + n
        stop = body + sum(lacing)
        if len(lacing) < n or stop > len(data):
            raise OggError("cut off in a page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : stop]) != crc:
            raise OggError("a page's checksum differs")
        if kind & BEGIN:
            if serial in streams:
                raise OggError("a logical stream begins twice")
            streams[serial] = Stream(serial)
        if serial not in streams:
            raise OggError("a logical stream does not begin")
        s = streams[serial]
        if s.ended or s.sequence != sequence or bool(kind & CONTINUED) != bool(s.open):
            raise OggError("a page is missing")
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append(b"".join([*s.open, data[body : body + size]]))
                s.granules.append(granule)
                s.open, body, size = [], body + size, 0
        if size or lacing[-1:] == b"\xff":
            s.open.append(data[body : body + size])
        s.sequence, s.ended = sequence + 1, bool(kind & END)
        at, count = stop, count + 1
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a logical stream does not end")
    return streams, count


def times(stream: Stream, rate: int) -> list[float]:
    """The second at which each packet after the first begins. A page's granule position is that of the last packet which ends
    on it; those before end as many samples earlier as come after them."""
    out, ends = [], 0
    for k in range(len(stream.packets) - 1, 0, -1):
        own = stream.granules[k]
        if k == len(stream.packets) - 1 or stream.granules[k + 1] != own:
            ends = own
        ends -= len(stream.packets[k])
        out.append(ends / rate)
    return out[::-1]


def read(data: bytes) -> tuple[bytes, str, list[float]]:
    """The stored samples, a line of features of the container and the samples, and the second at which each packet begins,
    stream by stream."""
    streams, count = demultiplex(data)
    parts, seconds, starts = {}, [], []
    for s in streams.values():
        name, number, of, frame, rate = IDENTITY.unpack(s.packets[0])
        if name != NAME or of != len(streams):
            raise OggError("not streams of samples")
        raw = b"".join(s.packets[1:])
        if s.granules[-1] != len(raw):
            raise OggError("the granule position differs from the samples")
        parts[number] = np.frombuffer(raw, np.uint8).reshape(-1, frame)
        seconds.append(s.granules[-1] / rate)
        starts += times(s, rate)
    total = sum(map(len, parts.values()))
    frames = np.empty((total, frame), np.uint8)
    for number, part in parts.items():
        frames[number :: len(parts)] = part
    samples = frames.reshape(-1)
    n = len(samples)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256, dtype=np.int64) - 128
    mean = int(counts @ values) / n
    power = int(counts @ (values * values)) / n
    high = samples >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    packets = sum(len(s.packets) for s in streams.values())
    line = f"streams={len(streams)};pages={count};packets={packets};seconds={max(seconds):.6f};mean={mean:.6f};rms={power**0.5:.6f};min={int(samples.min())};max={int(samples.max())};crossings={crossings}"
    return samples.tobytes(), line, starts


def padded(text: bytes) -> bytes:
    """text with spaces appended up to a positive multiple of a frame."""
    return text + b" " * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def store(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): every whole text's UTF-8, padded and stored as an Ogg bit stream. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())],
                    names=[id_col, "n_bytes", "media"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def load(df: DataFrame, media: str = "media") -> DataFrame:
    """df with `payload` (the stored samples), `feature`, `packet_seconds` (when each packet begins) and `media_error` (why the
    media is unreadable, else null). Columns of df with these names are replaced, but for the media itself.

    Null or damaged media give a null payload, feature and packet_seconds.
    """
    new = (("payload", BinaryType()), ("feature", StringType()), ("packet_seconds", ArrayType(DoubleType())), ("media_error", StringType()))
    if media in [name for name, _ in new]:
        df, media = df.withColumnRenamed(media, "media"), "media"
    df = df.drop(*(name for name, _ in new))
    schema = StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in new)])

    def one(data: bytes | None) -> tuple[bytes | None, str | None, list[float] | None, str | None]:
        if data is None:
            return None, None, None, None
        try:
            return *read(data), None
        except (OggError, struct.error, ValueError) as e:
            return None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [one(m) for m in part.column(part.schema.get_field_index(media)).to_pylist()]
                more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.list_(pa.float64()), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return df.mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    out = load(store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
