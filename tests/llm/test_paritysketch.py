import random
import re

import numpy as np
import pytest

from docveil.llm import paritysketch as ps
from docveil.llm import shingles as sh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def slow_join(rows):
    """Every pair, by an inverted index."""
    sets = [(d, slow_set(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = {}
    for i, (_, s) in enumerate(sets):
        common = {}
        for g in s:
            for j in index.get(g, ()):
                common[j] = common.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j][1]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_shingles_count_and_do_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [rng.choice(["", " "]) + rng.choice([" ", "\n", "\t  "]).join(rng.choice(["A", "b", "é", "cd", "the"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30]))) for _ in range(200)]
    value, owner = sh.shingles(*laid(texts))
    names = {}
    for d, t in enumerate(texts):
        assert (owner == d).sum() == len(slow_set(t)), repr(t)
        alone, _ = sh.shingles(*laid([t]))
        assert alone.tolist() == value[owner == d].tolist()
        names.setdefault(frozenset(slow_set(t)), set()).add(tuple(alone.tolist()))
    assert all(len(v) == 1 for v in names.values()) and len(set(map(str, names.values()))) == len(names)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 16, 40, 150, 700])
def test_linked_sets_share_a_key(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        n = int(rng.integers(0, size // 7 * 2 + 2))
        out = int(rng.integers(0, n + 1))
        b = np.concatenate([a[min(out, size - 1) :], rng.integers(0, 1 << 63, n - out, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        key, who = ps.keys(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert np.intersect1d(key[who == 0], key[who == 1]).size


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55 and texts:
            w = rng.choice(texts[-120:]).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.4:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
        elif kind < 0.8:
            w = passage + [rng.choice(words) for _ in range(rng.choice([5, 20, 60]))]
        else:
            w = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 30, 80, 200]))]
        texts.append(" ".join(w))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, few", [(1, 256), (2, 16), (3, 64)])
def test_against_every_pair(spark, monkeypatch, seed, few):
    monkeypatch.setattr(ps, "FEW", few)
    rows = [*corpus(seed), (90001, None), (90002, ""), (90003, " \n")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, component_id int")
    assert sorted(map(tuple, ps.join(df).collect())) == slow_join(rows)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ps.join(empty).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "A b\tc d e f"), (1, None)]
    out = sorted(map(tuple, ps.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == [(1, 0, 1), (3, 2, 3), (3, 2, 3), (5, 2, 3)]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, ps.op5(spark, "/root/testdata/sf0.01").collect())) == slow_join(rows)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    w, v, x, y = (say(n) for n in (60, 80, 400, 30))
    rows = [(1, w), (1, v), (2, w + " more"), (3, v + " more"), (4, x), (4, x + " more"), (4, y), (5, y + " " + say(1)), (9, say(50))]
    assert sorted(map(tuple, ps.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == slow_join(rows)
    rows = [(None, w), (5, w), (None, v + " more"), (7, v), (None, y), (None, None)]
    out = ps.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted([(None, 5), (5, 5), (None, 7), (7, 7), (None, None), (None, None)], key=str)
