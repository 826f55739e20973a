import zlib

import numpy as np
import pytest

from docveil.llm import langid


@pytest.mark.parametrize("n", [0, 1, 2, 4, 6, 7, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
    for i in range(n):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= max(1, code.shape[1] / 3 - 1e-9)


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(6)
    model = langid.Model(list("abcdef"), code, np.zeros((langid.BUCKETS, code.shape[1])))
    for k in range(6):
        margins = code[k].copy()
        margins[:3] *= -0.5
        best, score, ambiguous = model.decode(margins[None, :])
        assert best[0] == k and 0 <= score[0] <= 1 and not ambiguous[0]
    assert model.decode(np.zeros((1, code.shape[1])))[2][0]


def test_grams_do_not_cross_documents():
    raw = np.frombuffer(b"abcdxyz", np.uint8)
    both, owner = langid.grams(raw, np.array([0, 4, 7]))
    for k, part in enumerate((b"abcd", b"xyz")):
        alone, _ = langid.grams(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        assert sorted(alone) == sorted(both[owner == k])


def test_edge_rows(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en", "y"), (101, "", "de", "y"), (102, "12 34 !", None, "y"), (103, "hund katze", None, "y"), (103, "hund katze", None, "y"), (104, "the cat " * 200000, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.predict(df, langid.fit(df)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (100, 101, 102, 103, 104)] == ["und", "und", "und", "de", "en"]
    assert all(by[i].lang_pred == rows[i][2] for i in range(40)) and by[100].score == 0
    empty = spark.createDataFrame([], df.schema)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(empty)).collect()} == {"und"}


def test_weights_by_definition(spark):
    rows = [(i, f"{'abc'[i % 3] * 3} {'xyz'[i % 3]}{i}", "l" + str(i % 3)) for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = np.zeros((3, langid.BUCKETS))
    for _, text, lang in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        np.add.at(counts[int(lang[1])], langid.grams(raw, np.array([0, len(raw)]))[0], 1)
    share = (counts + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum(axis=1, keepdims=True)
    code = langid.codewords(3)
    want = np.stack([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in code.T], axis=1)
    assert model.languages == ["l0", "l1", "l2"] and np.allclose(model.weights, want)


def test_many_languages_are_all_learnt(spark):
    """More labels than any cap: each with its own letters."""
    say = lambda k: " ".join(chr(0x4E00 + 5 * k + j) * 3 for j in range(5)) + " "
    rows = [(3 * k + i, say(k) * 4, f"l{k}") for k in range(300) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(df.withColumnRenamed("lang", "own"), langid.fit(df), keys=("own",)).collect()
    assert sum(r.own == r.lang_pred for r in out) >= 0.98 * len(rows)
    with pytest.raises(ValueError):
        langid.predict(df.withColumnRenamed("lang", "score"), langid.fit(df.limit(0)), keys=("score",))


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = langid.op8(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    seen = [r for r in out if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in seen) / len(seen) > 0.95
