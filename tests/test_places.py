import pytest
from pyspark.sql import functions as F

from docveil.functions import numerals
from docveil.operators import audit, numbering, reports, review
from docveil.sources.dictionary import read_dictionary

SPANS = "array<struct<start:int,end:int,replacement:string>>"


def test_numerals(spark):
    rows = [(0, "0", "0"), (4, "iv", "d"), (27, "xxvii", "aa"), (1994, "mcmxciv", "r" * 77), (-1, "0", "0")]
    df = spark.createDataFrame([(n,) for n, *_ in rows], "n int").select("n", numerals.roman(F.col("n")).alias("r"), numerals.letters(F.col("n")).alias("l"))
    assert [tuple(r) for r in df.collect()] == rows


def test_versions_and_folders(spark):
    df = spark.createDataFrame([("1.10.2", "1.9"), (" 2 ", "1.99"), ("1.x", "1.0"), (None, "1")], "a string, b string")
    assert [r.x for r in df.select((numerals.version(F.col("a")) > numerals.version(F.col("b"))).alias("x")).collect()] == [True, True, None, None]
    names = spark.createDataFrame([('a/b: "c"  d.',), ("...",), (None,), ("x" * 100,)], "t string")
    assert [r.x for r in names.select(numerals.folder_name(F.col("t")).alias("x")).collect()] == ["a b c d", "untitled", "untitled", "x" * 80]


def test_auto_numbers(spark):
    rows = spark.createDataFrame([(1, "a", i, v) for i, v in enumerate([0, 1, 1, 2, 0, 2, 1, 3, 9])] + [(2, "b", 0, 0), (2, None, 1, 0)], "doc_id long, list_id string, p_idx int, level int")
    levels = spark.createDataFrame([("a", 0, 1, "upperRoman", "%1."), ("a", 1, 5, "decimal", "%1.%2"), ("a", 2, 1, "lowerLetter", "%2%3)"), ("a", 3, 1, "bullet", "-")], "list_id string, level int, start int, form string, shown string")
    got = numbering.auto_numbers(rows, levels).orderBy("doc_id", "p_idx").collect()
    assert [r.label for r in got] == ["I.", "I.5", "I.6", "6a)", "II.", "5a)", "II.5", None, None, None, None]


def test_places(spark):
    docs = spark.createDataFrame([(1, "one two\n\nthree four five"), (2, "")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 4, 7), (1, 15, 19), (2, 0, 0), (3, 0, 1)], "doc_id long, start int, end int")
    assert sorted(tuple(r) for r in reports.located(found, audit.paragraphs(docs)).select("doc_id", "start", "p_idx", "at").fillna(-1).collect()) == [(1, 4, 0, 4), (1, 15, 2, 6), (2, 0, -1, -1), (3, 0, -1, -1)]
    shown = found.join(docs, "doc_id").select(reports.excerpt(F.col("text"), F.col("start"), F.col("end"), 3).alias("x")).collect()
    assert {r.x for r in shown} == {"one two\n\nthree…", "…three four five", ""}


def test_masked_view(spark):
    edits = [(4, 8, "{{A}}"), (12, 14, "{{B}}")]
    df = spark.createDataFrame([("abcdSECRefghXYij", edits, a, b) for a, b in ((0, 16), (6, 13), (0, 4), (5, 7), (8, 12))], f"t string, e {SPANS}, a int, b int")
    got = [r.x for r in df.select(reports.masked_view(F.col("t"), F.col("a"), F.col("b"), F.col("e")).alias("x")).collect()]
    assert got == ["abcd{{A}}efgh{{B}}ij", "{{A}}efgh{{B}}", "abcd", "{{A}}", "efgh"]


def test_review(spark):
    labels = spark.createDataFrame([("m", "KISI", "{{KISI-01}}", ["Ayşe KARA"])], "matter_id string, label_type string, label string, values array<string>")
    masked = spark.createDataFrame([(1, "m", "{{KISI-01}} and {{KISI-1}}, {{VKN-02}}"), (2, "m", None), (3, "m", "")], "doc_id long, matter_id string, masked string")
    listed = {r.doc_id: (r.characters, r.labels, r.types) for r in review.listing(masked, labels).collect()}
    assert listed == {1: (38, 1, {"KISI": 1}), 2: (0, 0, None), 3: (0, 0, None)}
    out = {r.doc_id: (r.unmasked, r.resolved, r.unknown) for r in review.delivered(masked.withColumnRenamed("masked", "text"), labels).collect()}
    assert out == {1: ("Ayşe KARA and Ayşe KARA, {{VKN-02}}", 2, ["{{VKN-02}}"]), 2: (None, 0, []), 3: ("", 0, [])}
    part = review.part_of(masked, 2, 20).collect()
    assert [(r.doc_id, r.part, r.text) for r in part] == [(1, 2, "{{KISI-1}}, ")]


def test_revised(spark):
    texts = spark.createDataFrame([(1, "one two two"), (2, "abc"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one", "1", False), (1, "two", "2", True), (1, "none", "x", False), (2, "ab", "x", False), (2, "bc", "y", False), (3, "a", "b", False)], "doc_id long, old string, new string, all boolean")
    assert sorted(tuple(r) for r in review.revised(texts, asked).collect()) == [(1, "1 2 2", 2, 1), (2, "abc", 0, 2), (3, None, 0, 1)]


def test_dictionary(spark):
    read = read_dictionary("dosya: X\nmaskele:\n  - Poyraz\n  - deger: Ada\n    tur: gizli ad\n    varyantlar: [Ada A.Ş., 12]\nmaskeleme: [Kara Yolu]\n")
    assert (read.matter, read.entries, read.allowed) == ("X", [("Poyraz", "GİZLİ"), ("Ada", "GIZLI_AD"), ("Ada A.Ş.", "GIZLI_AD"), ("12", "GIZLI_AD")], ["Kara Yolu"])
    assert read_dictionary("").frame(spark).count() == 0
    with pytest.raises(ValueError):
        read_dictionary("maskele:\n  - tur: x\n")
