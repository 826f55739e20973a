import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from docveil.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference(enc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def ids(enc, text):
    import numpy as np

    return np.frombuffer(enc.encode([text])[0], "<i4").tolist()


def test_perfect_hash_is_minimal_and_exact(enc):
    assert all(enc.known.get(k) == v for k, v in enc.ranks.items())
    assert enc.known.n == len(enc.ranks) and len(set(enc.known.keys)) == len(enc.ranks)
    assert enc.known.get(b"not a token at all") == -1


def test_random_texts_equal_the_library(enc, reference):
    rng = random.Random(3)
    for _ in range(4000):
        s = "".join(rng.choice("ab 's\n\t　é١²x!  \r'llthe0Σ́日") for _ in range(rng.randint(0, 25)))
        assert ids(enc, s) == reference.encode_ordinary(s), repr(s)
    s = "".join(rng.choice("etaoin") for _ in range(3000))
    assert ids(enc, s) == reference.encode_ordinary(s)


def test_every_character_between_words(enc, reference):
    for c in map(chr, range(0x3000)):
        for s in (f"ab{c}cd", f"ab {c}{c} 1"):
            assert ids(enc, s) == reference.encode_ordinary(s), hex(ord(c))


def test_dataframe(spark, reference):
    rows = [(1, "Hello  there\n", "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "ñandú " * 500, "z")]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, P.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        assert r.ids == reference.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_query(spark, sf_dir, reference):
    rows = {r.doc_id: r for r in bpe.op10(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = reference.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
