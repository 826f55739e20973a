import hashlib
import random

import numpy as np
import pytest

from docveil.llm import digest


def slow_entropies(data):
    out = []
    for i in range(len(data) - 63):
        counts = np.bincount(data[i : i + 64], minlength=256)
        total = int(digest._C_LOG_C[counts].sum())
        full = int(digest._C_LOG_C[64])
        out.append((full - total) * 1000 // full)
    return out


@pytest.mark.parametrize("n", [0, 10, 64, 65, 700])
def test_entropies(n, monkeypatch):
    monkeypatch.setattr(digest, "STRIP", 100)
    data = np.frombuffer(bytes(random.Random(n).choice(b"aaab cdefgh") for _ in range(n)), np.uint8)
    assert digest.entropies(data).tolist() == slow_entropies(data)


def slow_selected(data, ranks):
    """By the definition, one document."""
    r = [(int(ranks[e]), i) for i, e in enumerate(slow_entropies(data))]
    if not r:
        return []
    popular = [0] * len(r)
    for i in range(len(r) - 63):
        popular[min(r[i : i + 64])[1]] += 1
    return [i for i, p in enumerate(popular) if p >= 16] or [min(r)[1]]


def test_selection_by_document():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"etaoin shrdlu.") for _ in range(n)) for n in (0, 5, 63, 64, 100, 127, 128, 400, 900, 0, 300)]
    ranks = np.random.default_rng(1).permutation(1001).astype(np.uint16)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, owner = digest.selected(np.frombuffer(b"".join(texts), np.uint8), offsets, ranks)
    for d, t in enumerate(texts):
        assert (starts[owner == d] - offsets[d]).tolist() == slow_selected(np.frombuffer(t, np.uint8), ranks)


def test_digests_do_not_depend_on_neighbours(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"etaoin shrdlu.") for _ in range(rng.choice([0, 3, 64, 500, 30000]))) for _ in range(30)]
    ranks = np.arange(1001).astype(np.uint16)
    every = digest.digests(texts, ranks)
    for t, chain in zip(texts, every):
        assert digest.shown(chain) == digest.shown(digest.digests([t], ranks)[0])
    long = [c for c in every if len(c) > 1]
    assert long and all(digest.likeness(c, c) == 1 for c in every)
    assert all(0 <= digest.likeness(a, b) <= 1 for a in every for b in every)
    assert digest.likeness(every[0][:0], long[0]) == 0


def expected_order(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    return {a[0]: b for a, b in zip(rows, [*rows[1:], rows[0]])}


def test_edge_rows(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "é", "some words " * rng.randint(1, 40)])) for i in rng.sample(range(10**6), 60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, edited string")
    out = {r.doc_id: r for r in digest.fingerprints(df, digest.rarity(df)).collect()}
    following = expected_order(rows)
    assert len(out) == 60
    for k, t in rows:
        assert out[k].edited == digest.edited(t or "", following[k][1] or "")
    same = {}
    assert all(same.setdefault(r.text, r.fingerprint) == r.fingerprint for r in out.values())
    one = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    assert digest.fingerprints(one, digest.rarity(one)).first().edited == "abab"
    twice = spark.createDataFrame([(7, "abcd"), (7, "abcd"), (7, None), (None, "x")], "doc_id long, text string")
    assert digest.fingerprints(twice, digest.rarity(twice)).count() == 4
    none = spark.createDataFrame([], df.schema)
    assert digest.fingerprints(none, digest.rarity(none)).count() == 0


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    following = expected_order(docs)
    out = {r.doc_id: r for r in digest.op7(spark, sf_dir).collect()}
    assert len(out) == len(docs)
    for k, t in docs:
        r = out[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(digest.edited(t, following[k][1]).encode()).hexdigest()
    long = [out[k] for k, t in docs if len(t) > 1000]
    assert np.mean([r.near_edited for r in long]) > 3 * np.mean([r.near_next for r in long]) and np.mean([r.near_edited for r in long]) > 0.3


def slow_chain(text, ranks):
    """Filters as sets of bits, feature by feature."""
    data = np.frombuffer(text, np.uint8)
    if not text:
        return []
    windows = [data[i : i + 64] for i in slow_selected(data, ranks)] if len(text) >= 64 else [np.frombuffer(text.ljust(64, b"\0"), np.uint8)]
    features = list(dict.fromkeys(int(digest.hashes(w.copy(), np.array([0]))[0]) for w in windows))
    return [{(v >> (11 * k)) % 2048 for v in features[i : i + 160] for k in range(5)} for i in range(0, len(features), 160)]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    best = []
    for x in a:
        scores = []
        for y in b:
            full, chance = min(len(x), len(y)), len(x) * len(y) / 2048
            spread = (chance * (1 - len(x) / 2048) * (1 - len(y) / 2048)) ** 0.5
            floor = chance + min(4 * spread, 0.3 * (full - chance))
            scores.append(min(1.0, max(0.0, (len(x & y) - floor) / max(full - floor, 1e-9))))
        best.append(max(scores))
    return sum(best) / len(best)


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 200])))) for i in range(12)]
    rows += [(100, rows[11][1]), (99, rows[11][1] + " more"), (50, " ".join(rng.choice(words) for _ in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = digest.rarity(df)
    following = expected_order(rows)
    for r in digest.fingerprints(df, ranks).collect():
        mine, after, half = (slow_chain(t.encode(), ranks) for t in (r.text, following[r.doc_id][1], digest.edited(r.text, following[r.doc_id][1])))
        packed = b"".join(np.packbits(np.isin(np.arange(2048), list(x))).tobytes() for x in mine)
        assert r.fingerprint == digest.shown(np.frombuffer(packed, np.uint8).reshape(len(mine), 256))
        assert r.near_next == pytest.approx(slow_likeness(mine, after)) and r.near_edited == pytest.approx(slow_likeness(mine, half))


def test_ranges_do_not_share_tasks(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'some words' AS text")
    sizes = [r["count"] for r in digest.in_order(df, "doc_id", "text").groupBy(digest.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1400


def test_very_long_and_half_edited(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("etaoin shrdlu.,ABC") for _ in range(n))
    rows = [(i, text(1000)) for i in range(40)] + [(40, text(2_000_000)), (41, text(2_000_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = digest.fingerprints(df, digest.rarity(df)).collect()
    assert min(r.near_edited for r in out) > 0.2 and max(r.near_next for r in out) < 0.1
