import re

from pyspark.sql import functions as F

import corpus_pipeline
from test_packing import reference, verify  # noqa: F401
from test_paritysketch import slow_join


def slow_texts(rows):
    """Brute-force removal of repeated strings, then of characters cut in two."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        out[key] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark, sf_dir, reference):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now, frames = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.staged(stage(spark, now, sf_dir), name)
        frames[name] = now
        assert name == "sequences" or now.columns == columns
    text = {r.doc_id: r.text for r in docs.collect()}
    told = {r.doc_id: r.text for r in frames["language"].collect()}
    assert all(text[k] == v for k, v in told.items())
    lost = set(text) - set(told)
    assert all(not re.search(r"[^\W\d_]", text[k]) for k in lost)
    stay = {d for d, _, c in slow_join(list(told.items())) if d == c}
    near = {r.doc_id: r.text for r in frames["near_duplicates"].collect()}
    assert near == {k: told[k] for k in stay}
    want = {k: v for k, v in slow_texts(near.items()).items() if v}
    last = {r.doc_id: r for r in frames["repeated_passages"].collect()}
    assert {k: r.text for k, r in last.items()} == want and all(r.n_chars == len(r.text) for r in last.values())
    verify(list(want.items()), frames["sequences"].collect(), reference)


def test_edge_rows(spark, tmp_path, reference):  # noqa: F811
    long = "Der Hund und die Katze " * 20
    rows = [(1, None, "de", "s", 0), (2, "", "de", None, 0), (3, "123", None, "s", 3), (4, long, "de", "s", 9), (4, long, "de", "s", 9), (5, long + "!", "de", "s", 1), (6, "The cat and the dog", "en", "s", 1), (None, "The cat and a bird", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {4, 6, None}
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    long = "Der Hund und die Katze gehen heute in den Wald und essen dort einen Kuchen "
    rows = [(i, f"{long} {i} {i + 1} {i * 7} ende {'hund ' * i}", "de", 0.5, True, "x", "k", 3, 2) for i in range(6)]
    rows += [(0, "The cat and the dog walk into a wood and eat the cake that is there", "en", 0.5, True, "x", "k", 3, 2), (None, "Le chat et le chien vont dans la forêt pour manger un gâteau", "fr", 0.1, None, "", "", 1, 2), (None, "El gato y el perro van al bosque para comer una tarta buena", "es", 0.1, None, "", "", 1, 2)]
    kind = "doc_id long, text string, lang string, score double, ambiguous boolean, lang_pred string, kept string, kept_id int, row int"
    docs = spark.createDataFrame(rows, kind).withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("clash"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = corpus_pipeline.staged(stage(spark, now, ""), name)
        assert now.columns == docs.columns
    out = now.collect()
    assert {(r.doc_id, r.lang) for r in out if r.lang != "de"} == {(0, "en"), (None, "es"), (None, "fr")}
