import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docveil.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda s: [*t.encode(s, add_special_tokens=False).ids, packing.END_ID]


def test_tokens_equal_the_library(reference):
    mine = packing.Tokens(PATH)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abT 's\n\t　é١²x!_ \rS'llthe0ΣÉİ́日<|endoftext|>") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [f"ab{chr(c)}Cd {chr(c)} 1" for c in range(0x2200)]
    texts += ["see <|endoftext|> x", "<|startoftext|>", "a<|ENDOFTEXT|>b <|endoftext|><|endoftext|>", "<|endoftext |> <| endoftext|>"]
    for t, raw in zip(texts, mine.encode(texts)):
        assert [*np.frombuffer(raw, "<u4").tolist(), 2] == reference(t), repr(t)
    assert np.frombuffer(mine.encode(["see <|endoftext|> x"])[0], "<u4").tolist() == [862, 49407, 343]


def check(rows, capacity):
    """Sequences gapless from 0 and within the capacity."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_cover_each_rank_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 4096])
    histogram = {rng.randint(1, capacity): rng.choice([1, 2, 7, 300]) for _ in range(60)}
    rows, ranks = [], defaultdict(list)
    for length, rank, many, sequence, offset in packing.patterns(histogram, capacity):
        ranks[length] += range(rank, rank + many)
        rows += [(length, sequence + i, offset) for i in range(many)]
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    used = check(rows, capacity)
    assert used >= -(-sum(n * c for n, c in histogram.items()) // capacity)
    assert packing.patterns({}, capacity) == []


@pytest.mark.parametrize(
    "histogram",
    [{100: 1000}, {1: 100_000}, {7: 50_000, 5: 3}, {1: 20_000, 30: 20_000, 41: 20_000}, {4096: 10, 3000: 50, 100: 90_000, 1: 45_000}],
)
def test_hot_short_lengths_share_sequences(histogram):
    rows = [(n, first + i, o) for n, _, many, first, o in packing.patterns(histogram) for i in range(many)]
    assert len(rows) == sum(histogram.values())
    assert check(rows, 4096) <= 1 + 1.03 * sum(n * c for n, c in histogram.items()) / 4096
    assert len(packing.runs(histogram)) <= 20


def test_hot_short_lengths_in_spark(spark):
    data = [(i, 0, 1 if i % 3 == 0 else 5) for i in range(900)]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, start long, length long"), 64).collect()
    assert len(out) == 900 and {r.doc_id for r in out} == set(range(900))
    assert check([(r["length"], r.sequence_id, r.offset) for r in out], 64) <= 1.03 * -(-3300 // 64)


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    rng = random.Random(1)
    data = [(i // 2, 0, rng.choice([5, 5, 5, rng.randint(1, 16)]), "x") for i in range(800)]
    df = spark.createDataFrame(data, "doc_id long, start long, length long, other string")
    out = packing.pack(df, 16).collect()
    assert len(out) == 800
    check([(r["length"], r.sequence_id, r.offset) for r in out], 16)
    assert packing.pack(spark.createDataFrame([], df.schema), 16).count() == 0


def test_edge_rows(spark, reference):
    rows = [(1, None, 5), (2, "", 5), (3, "Word " * 9000, 5), (4, "Same", 5), (4, "Same", 5)]
    out = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    verify(rows, out, reference)


def verify(rows, out, reference):
    check([(r["length"], r.sequence_id, r.offset) for r in out], 4096)
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
    n = defaultdict(int)
    for d, text, *_ in rows:
        n[d] += 1
    for d, text, *_ in rows:
        ids = np.array(reference(text or ""), "<u4")
        parts = sorted(got[d], key=lambda r: r.start)[:: n[d]]
        assert sum(r["length"] for r in parts) == len(ids) and parts[0].start == 0
        for r in parts:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r["length"]].tobytes())


def test_query(spark, sf_dir, reference):
    out = packing.op2(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    verify([tuple(d) for d in docs], out, reference)
    sequences = len({r.sequence_id for r in out})
    assert sequences <= 1.03 * -(-sum(r["length"] for r in out) // 4096)
