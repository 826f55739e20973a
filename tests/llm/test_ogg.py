import hashlib
import zlib

import pytest

from docveil.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)), b"OggS" * 99])
def test_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [192, 384, 192 * 3, 192 * 80, 192 * 81, 192 * 4001])
def test_round_trip(n):
    payload = bytes((i * 31 + i // 255) % 256 for i in range(n))
    data = ogg.write(payload)
    back, feature, starts = ogg.read(data)
    assert back == payload and f"streams=2;" in feature
    size = ogg.PACKET_FRAMES * ogg.FRAME
    halves = [sum(192 for i in range(n // 192) if i % 2 == k) for k in (0, 1)]
    assert starts == [i / ogg.RATE for h in halves for i in range(0, h, size)]
    assert ogg.write(payload) == data


def test_packets_that_are_multiples_of_255_and_span_pages():
    packets = [b"h", b"x" * 255, b"", b"y" * 70000, b"z" * 510]
    data = b"".join(p for _, p in ogg.pages(packets, [0, 1, 2, 3, 4], 7))
    streams, _ = ogg.demultiplex(data)
    assert streams[7].packets == packets and streams[7].granules[-1] == 4


def test_damage_is_found():
    data = ogg.write(b"q" * 192 * 500)
    for at in (3, 30, 5000, len(data) - 1):
        with pytest.raises((ogg.OggError, ValueError)):
            ogg.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read(data[:-5])


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "é" * 96, "c"), (3, "é" * 96, "c"), (4, "x" * 300000, None)]
    out = ogg.load(ogg.store(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    assert len(out) == 5
    for r in out:
        text = (next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()
        assert r.n_bytes == len(text) and bytes(r.payload).startswith(text) and bytes(r.payload)[len(text) :].strip(b" ") == b""
        assert len(r.payload) % 192 == 0 and len(r.payload) > 0 and r.media_error is None
    assert len({bytes(r.media) for r in out if r.doc_id in (1, 2)}) == 1
    bad = ogg.load(spark.createDataFrame([(1, b"nothing of the kind"), (2, None)], "doc_id long, media binary")).collect()
    assert all(r.payload is None for r in bad) and bad[0].media_error
    assert ogg.store(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packet_times_on_pages_of_several_packets():
    packets = [b"h", b"a" * 100, b"b" * 200, b"c" * 70000, b"d" * 30]
    data = b"".join(p for _, p in ogg.pages(packets, [0, 100, 300, 70300, 70330], 7))
    streams, _ = ogg.demultiplex(data)
    assert ogg.times(streams[7], 10) == [0.0, 10.0, 30.0, 7030.0]


def test_clashing_columns(spark):
    rows = [(1, "abc", "p", 2, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string, feature int, media_error string")
    stored = ogg.store(df).join(df.drop("text"), "doc_id")
    out = ogg.load(stored).first()
    assert bytes(out.payload).strip() == b"abc" and out.media_error is None and out.packet_seconds == [0.0]
    renamed = ogg.load(ogg.store(df).withColumnRenamed("media", "payload"), "payload").first()
    assert bytes(renamed.payload).strip() == b"abc"


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in ogg.op6(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = ogg.padded((d.text or "").encode())
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len((d.text or "").encode()), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.media_sha256 == hashlib.sha256(ogg.write(want)).hexdigest()
