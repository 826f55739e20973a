import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docveil.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, rank int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or ""))]


def grams(texts, sizes):
    return Counter(tuple(w[i : i + m]) for t in texts for w in pieces(t) for m in sizes for i in range(len(w) - m + 1))


def plain(rows, most=3, least=10, within=50, top=2000):
    """By definition, with dictionaries."""
    by = defaultdict(list)
    for text, lang in rows:
        by["und" if lang is None else lang].append(text)
    out = []
    for lang, texts in by.items():
        f = grams(texts, range(1, most + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = [g for g, c in f.items() if len(g) > 1 and c >= least]
        inside = defaultdict(int)
        for g in found:
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], f[g])
        told = []
        for g in found:
            a = f[g]
            if 100 * inside[g] >= within * a and inside[g]:
                continue
            score, _, l, r = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            told.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(told)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts(seed, n, words=30):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "New York", "new", "York city", "é", " x", "w1", "w2", "Zz", "\U0001f600", "q\tr"]
    ends = [" ", " ", " ", "\t", ". ", ",", "\n", "\r\n", "; ", "  "]
    pick = lambda: "".join(vocabulary[min(int(rng.exponential(3)), 11)] + ends[rng.integers(10)] for _ in range(words))
    return [pick() for _ in range(n)]


@pytest.mark.parametrize("most", [2, 3, 5])
def test_against_dictionaries(spark, most):
    rows = [(t, [None, "und", "de", "en", "en"][i % 5]) for i, t in enumerate(texts(most, 200))]
    rows += [(None, "en"), ("", "fr"), (" \t.", "es"), ("once only", "pt"), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(i, *r, 0, "p", 1) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    for more in ({}, {"top": 7}, {"within": 90}, {"least": 40}):
        got = co.collocations(df, max_words=most, **more)
        assert sorted(map(tuple, got.collect())) == plain(rows, most, **{"top": 2000, **more})


def test_edge_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert co.collocations(df).collect() == []
    with pytest.raises(ValueError):
        co.collocations(df, max_words=1)
    # ties in every regard come by bytes; equal words next to each other overlap
    rows = [("b c. a c. é c. " * 10, "x"), ("o o o o o o o o o o o o", "y"), (None, None)]
    df = spark.createDataFrame([(i, *r, 0, "", 0) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, co.collocations(df).collect()))
    assert got == plain(rows) and [r[2] for r in got if r[0] == "x"] == ["a c", "b c", "é c"]


def test_shards_are_cut_between_pieces(monkeypatch):
    long = "x" * 300 + " y z."
    rows = [(t, ["de", "en"][i % 2]) for i, t in enumerate([*texts(9, 40), long * 3, " ".join(["v"] * 500), None, "."])]
    want = {lang: grams([t for t, l in rows if l == lang], (1, 2, 3)) for lang in ("de", "en")}
    batches = [pa.RecordBatch.from_arrays([pa.array([l for _, l in part]), pa.array([t for t, _ in part], pa.string())], names=["lang", "text"]) for part in (rows[:25], rows[25:])]
    for shard, starts in ((1 << 23, 1 << 16), (200, 16), (64, 32), (5000, 48)):
        monkeypatch.setattr(co, "SHARD", shard)
        monkeypatch.setattr(co, "STARTS", starts)
        got = {lang: Counter() for lang in want}
        for s in co.shards(iter(batches)):
            names = [w.decode() for w in s.words.to_pylist()]
            assert s.n == s.seen.sum() == np.bitwise_count(s.bits).sum()
            for rows, counts in ((np.arange(len(names))[:, None], s.seen), *s.phrases(3)):
                for row, n in zip(rows, counts):
                    got[s.lang][tuple(names[w] for w in row)] += int(n)
            assert s.hashed(2, None)[1].sum() == s.n + sum(n for rows, n in s.phrases(2) for n in n)
        assert got == want


def test_a_full_filter_changes_nothing(monkeypatch):
    s = co.Shard("en", np.frombuffer(b"a b c\na b c\nb c d", np.uint8))
    everything, nothing = np.full(co.FILTER_BITS >> 6, ~np.uint64(0)), np.zeros(co.FILTER_BITS >> 6, np.uint64)
    told = lambda seen: [(r.tolist(), n.tolist()) for r, n in s.phrases(3, seen)]
    assert told(everything) == told(None) and [len(r) for r, _ in told(None)] == [3, 2]
    assert told(nothing) == []


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)], co.COUNTS)
    assert [tuple(r) for r in co.scored(counts.where("size = 2"), counts).collect()] == [("en", "a b", big, big, 2 * big, 500000)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    want, got = con.sql(co.SQL), co.op12(spark, "/root/testdata/sf0.01")
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
