import gzip
import hashlib

import pytest

from docveil.llm import warc


def test_records_are_gzip_members_and_chunks_join():
    payload = bytes(range(256)) * 5000
    for refers in (None, "urn:page:1"):
        member = b"".join(warc.record("urn:page:2", "http://a/\r\nb", payload, refers))
        raw = gzip.decompress(member)
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert b"WARC-Target-URI: http://a/%0D%0Ab\r\n" in raw and (payload in raw) == (refers is None)
        parts = list(warc.chunks(iter([member]), 1000))
        assert b"".join(parts) == member and all(len(p) == 1000 for p in parts[:-1])
        r, crc = warc.Reader("x"), 0
        for k, p in enumerate(parts):
            crc = warc.zlib.crc32(p, crc)
            r.feed(k, p, crc)
        assert r.end() == ("urn:page:2", "revisit" if refers else "response", len(payload), warc.base32_sha1(hashlib.sha1(payload).digest()), refers)


def test_lost_chunk():
    parts = list(warc.chunks(warc.record("urn:page:2", None, bytes(range(256)) * 500, None), 100))
    r = warc.Reader("x")
    r.feed(0, parts[0], warc.zlib.crc32(parts[0]))
    with pytest.raises(warc.WarcError):
        r.feed(2, parts[2], warc.zlib.crc32(parts[2]))
    with pytest.raises(warc.WarcError):
        r.end()


def expected(rows):
    payloads = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        payloads.setdefault(raw, []).append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        least = min(payloads[raw])
        out.append((p, len(raw), warc.base32_sha1(hashlib.sha1(raw).digest()), "response" if p == least else "revisit", None if p == least else least))
    return sorted(out, key=str)


def test_edge_rows(spark):
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "u", "same"), (7, "v", None), (8, "w", ""), (1, "x", "y" * 900000), (1, "x", "y" * 900000), (2, "", "é\x00")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.read(warc.write(df)).collect()), key=str) == expected(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(empty)).count() == 0
    small = warc.read(warc.write(df, least=10)).where("record_type = 'revisit'")
    assert small.count() == 0


def test_rows_without_an_id(spark):
    rows = [(None, "u", "same"), (5, "u", "same"), (7, None, "same"), (None, "v", "lone"), (None, "w", "twin"), (None, "w", "twin")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect()), key=str)
    assert out == sorted([(None, 4, "revisit", 5), (5, 4, "response", None), (7, 4, "revisit", 5), *[(None, 4, "response", None)] * 3], key=str)


def test_query_and_archive(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op9(spark, sf_dir).collect()), key=str) == expected(rows)
    table = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    data = b"".join(bytes(r.data) for r in table.where("archive = 0").orderBy("position", "chunk_no").collect())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == table.where("archive = 0").select("record_id").distinct().count()
