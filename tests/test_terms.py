import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docveil.operators import audit, filters, masking, rules, terms


def test_guards(spark):
    text = 'Acme "Hizmet Sağlayan" demektir. Sayın Hizmet Sağlayan imzalar. Bkz. Donoghue v Stevenson [1932] ve Sayın Cem Oral 12345678901 ve 12345678901'
    df = spark.createDataFrame([(text,)], "text string")
    out = rules.detect(df, rules.of_profile("standart")).withColumn("d", terms.definitions(F.col("text"))).withColumn("f", terms.foreign_citations(F.col("text")))
    out = out.select(filters.outside(terms.without_defined(F.col("candidates"), F.col("d")), F.col("f"), "SOZLUK").alias("c")).first().c
    assert {f.text for f in out if f.entity == "PERSON"} == {"Cem Oral"}
    kept = masking.resolved(df, rules.of_profile("standart")).select(terms.residual_candidates(F.col("text"), F.col("kept"), F.col("suspects")).alias("r")).first().r
    assert [(f.label_type, f.score, f.text) for f in kept] == [("11 digits", 45, "12345678901")] * 2


def test_parties_and_terms(spark):
    text = "\n".join([
        '"Alpha Works" means one. "Beta Works" means two.',
        "we see Gamma Plan here, then Gamma Plan again and Solo once",
        'Mavi Deniz Lojistik A.Ş. (the "Supplier") and Yeşil Orman A.Ş. (the "Buyer")',
        'Mavi Deniz Lojistlk A.Ş. came; Kuzey Tepe A.Ş. (the "Supplier")',
    ])
    rows = audit.paragraphs(spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string"))
    assert [(r.term_key, r.n) for r in terms.undefined_terms(rows).collect()] == [("gamma plan", 2)]
    assert [(r.a, r.b) for r in terms.party_spellings(rows).collect()] == [("mavi deniz lojistik", "mavi deniz lojistlk")]
    assert [(r.role, r.parties) for r in terms.role_conflicts(rows).collect()] == [("supplier", ["kuzey tepe", "mavi deniz lojistik"])]


def test_spellings_are_all_pairs(spark):
    rng = random.Random(8)
    stems = ["mavi deniz lojistik", "kuzey tepe insaat", "aa", "aaaaaaaa", "abababab", "yesil", "x"]
    names = set()
    for d in range(6):
        for _ in range(60):
            n = list(rng.choice(stems))
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(n) + 1)
                n[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "e", " ", "ss"])
            names.add((d, "".join(n)))
    rows = [*names, *list(names)[:50], (1, None), (None, "abc")]
    for least in (0.7, 0.86, 0.95):
        got = {tuple(r) for r in terms.spellings(spark.createDataFrame(rows, "doc_id int, name string"), least).collect()}
        want = {(d, a, b) for d, a in names for e, b in names if d == e and a and a < b and not b.startswith(a) and least <= SequenceMatcher(None, a, b, autojunk=False).ratio() < 1}
        assert got == want and len(want) > 10
    assert terms.spellings(spark.createDataFrame([], "doc_id int, name string")).count() == 0
