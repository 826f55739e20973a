import hashlib
import random

import pytest

from docveil.llm import induced, suffixdedup
from docveil.llm.anchors import SPAN


def slow(rows):
    """By the definition, with every string of SPAN bytes in one dictionary."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - SPAN + 1):
            part = raw[i : i + SPAN]
            if part in seen:
                gone[i : i + SPAN] = b"\1" * SPAN
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shown(df):
    return sorted((*r[:4], hashlib.sha256(bytes(r[4])).hexdigest()) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.choice([12, 20, 40, 80]))) for _ in range(6)]
    texts = []
    for _ in range(150):
        kind = rng.random()
        if kind < 0.2 and texts:
            t = rng.choice(texts)
        elif kind < 0.4 and texts:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind < 0.5:
            t = rng.choice(["-", "ab", "The ", " \n"]) * rng.choice([10, 49, 50, 51, 99, 100, 101, 150, 400])
        else:
            t = " ".join([*(word() for _ in range(rng.randint(0, 30))), rng.choice(passages), *(word() for _ in range(rng.randint(0, 30)))])
            if rng.random() < 0.5:
                t += rng.choice(passages)[5:] + rng.choice(passages)
        texts.append(t)
    return list(zip(rng.sample(range(1000), 150), texts))


@pytest.mark.parametrize("seed, small", [(1, False), (2, True), (3, True)])
def test_against_all_strings(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(suffixdedup, "SHARD", 2000)
        monkeypatch.setattr(suffixdedup, "IN_MEMORY", 1500)
        monkeypatch.setattr(induced, "MEMORY", 500)
        monkeypatch.setattr(induced, "COMPARED", 50)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, first int, kept string")
    assert shown(suffixdedup.dedup(df)) == slow(rows)


@pytest.mark.parametrize("limit", [20000, 1000])
def test_hot_gram_is_split(spark, monkeypatch, limit):
    class Bounded(suffixdedup.Shard):
        def copies(self):
            assert self.size <= 2 * limit + 400
            return super().copies()

    monkeypatch.setattr(suffixdedup, "SHARD", limit)
    monkeypatch.setattr(suffixdedup, "Shard", Bounded)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("etaoinshrdlu ") for _ in range(n))
    lines, lefts, rights = [word(60), word(120)], [word(60) for _ in range(5)], [word(70) for _ in range(5)]
    pick = lambda some: rng.choice(some) if rng.random() < 0.3 else word(rng.randint(0, 150))
    rows = [(i, pick(lefts) + rng.choice(lines) + pick(rights)) for i in rng.sample(range(5000), 500)]
    assert shown(suffixdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)


def test_edge_rows(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300000))
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, long), (6, long[100:250] + "!" + long[299000:]), (7, "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(suffixdedup.dedup(df)) == slow(rows)
    twice = spark.createDataFrame([(1, long[:500]), (1, long[:500]), (2, long[:500]), (None, long[:200])], "doc_id long, text string")
    assert [tuple(r[:3]) for r in suffixdedup.dedup(twice).orderBy("doc_id").collect()] == [(None, 200, 0), (1, 500, 200), (1, 500, 200), (2, 500, 500)]
    assert suffixdedup.dedup(spark.createDataFrame([], df.schema)).count() == 0


def test_repeated_ids_of_different_texts(spark):
    """Each text of an id is a document of its own: nothing is cut from one for what another one repeats."""
    rng = random.Random(10)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = say(400), say(3000)
    rows = [(1, passage + say(50)), (2, say(30) + passage[:250] + say(20)), (2, other), (2, other), (None, say(200) + passage[:120]), (None, say(150)), (3, other[1000:1300] + passage), (4, None), (4, "x" * 300)]
    df = spark.createDataFrame([(*r, i, "y") for i, r in enumerate(rows)], "doc_id long, text string, n int, kept string")
    hashes = {r.n: r.h for r in df.selectExpr("n", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashes[i]))
    at = {}
    for i in order:
        at.setdefault((rows[i][0], hashes[i]), len(at))
    one = {at[rows[i][0], hashes[i]]: rows[i][1] for i in order}
    want = {k: r for k, *r in slow(list(one.items()))}
    got = suffixdedup.dedup(df, carry="n").collect()
    assert sorted((r.n, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == sorted((i, *want[at[rows[i][0], hashes[i]]]) for i in range(len(rows)))
    assert sum(r.n_removed for r in got) > 1000 and {r.n_removed for r in got if r.n in (2, 3)} == {0}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, suffixdedup.op3(spark, sf_dir).collect())) == slow(rows)
