import random
import re

import pytest
from pyspark.sql import functions as F

from docveil.functions import checks, textfold
from docveil.functions.morphology import inflected
from docveil.operators import evaluate, filters, masking, resolve, rules, scan, vault
from docveil.operators.match import line_number, spans, splice


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "no match", "a1b22c333", "😀12 é3😀", "1", "12\n34"])
def test_spans(spark, text):
    got = [(s.start, s.end, s.text) for s in one(spark, text, spans(F.col("text"), "[0-9]+"))]
    assert got == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert [one(spark, text, line_number(F.col("text"), F.lit(a))) for a, _, _ in got] == [text[:a].count("\n") + 1 for a, _, _ in got]


def test_splice(spark):
    edits = F.expr("array(named_struct('start', 6, 'end', 9, 'replacement', 'X'), named_struct('start', 0, 'end', 1, 'replacement', 'ABC'))")
    assert one(spark, "h😀llo you!", splice(F.col("text"), edits)) == "ABC😀llo X!"
    bad = F.expr("array(named_struct('start', 0, 'end', 3, 'replacement', ''), named_struct('start', 2, 'end', 4, 'replacement', ''))")
    assert one(spark, "abcdef", splice(F.col("text"), bad)) is None


def national(prefix):
    d = [int(c) for c in prefix]
    d.append((sum(d[0::2]) * 7 - sum(d[1::2])) % 10)
    return "".join(map(str, [*d, sum(d) % 10]))


def tax(prefix):
    total = 0
    for i, c in enumerate(prefix):
        t = (int(c) + 9 - i) % 10
        total += 9 if t and t * 2 ** (9 - i) % 9 == 0 else t * 2 ** (9 - i) % 9
    return prefix + str(-total % 10)


def test_check_digits(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        p = "".join(rng.choice("123456789") for _ in range(9))
        for make, name in ((national, "n"), (tax, "t")):
            v = make(p)
            wrong = v[:-1] + str((int(v[-1]) + 1) % 10)
            rows += [(name, v, True), (name, wrong, False)]
    rows += [("n", "0" + national("123456789")[1:], False), ("n", "", False), ("n", None, False), ("t", "12", False)]
    rows += [("i", "TR33 0006 1005 1978 6457 8413 26", True), ("i", "GB82WEST12345698765432", True), ("i", "GB82WEST12345698765431", False), ("i", "TR3300061005197864578413", False)]
    out = spark.createDataFrame(rows, "k string, v string, ok boolean").withColumn("got", F.when(F.col("k") == "n", checks.national_id(F.col("v"))).when(F.col("k") == "t", checks.tax_id(F.col("v"))).otherwise(checks.iban(F.col("v"))))
    assert out.where("not (got <=> ok)").collect() == []


def test_folding(spark):
    t = F.col("text")
    assert one(spark, "Iİ ŞEBNEM", textfold.tr_lower(t)) == "ıi şebnem"
    assert one(spark, "ıi ş", textfold.tr_upper(t)) == "Iİ Ş"
    assert one(spark, "Şebnem IĞDIR", textfold.ascii_lower(t)) == "sebnem igdir"
    assert one(spark, " Kuzey  Yıldızı Lojistik A.Ş. ", textfold.company_core(t)).startswith("kuzey yildizi lojistik")


PETITION = """Davacı: Ayla Kaynarca
Vekili: Av. Berk Tanyolaç
Karşı taraf Mavi Deniz Lojistik A.Ş. ile imzalanan sözleşme uyarınca Ayla Kaynarca ödeme yapmıştır.
TC Kimlik No: {n}, vergi no {t}, IBAN TR330006100519786457841326, tel 0532 111 22 33
E-posta ayla@ornek.example, dosya no: 2021/145
Yargıtay 3. HD. 2019/77 E. sayılı kararı
Tutar 1.250,00 TL""".format(n=national("123456789"), t=tax("123456789"))


def petition(spark):
    return spark.createDataFrame([(1, "m", PETITION)], "doc_id long, source string, text string")


def test_petition(spark):
    out = masking.resolved(petition(spark), rules.of_profile("standart")).first()
    kept = {(f.label_type, f.text) for f in out.kept}
    wanted = {("KISI", "Ayla Kaynarca"), ("KISI", "Berk Tanyolaç"), ("TCKN", national("123456789")), ("VKN", tax("123456789")), ("IBAN", "TR330006100519786457841326"), ("TELEFON", "0532 111 22 33"), ("EPOSTA", "ayla@ornek.example"), ("DOSYA_NO", "2021/145")}
    assert wanted <= kept, wanted - kept
    assert any(t == "SIRKET" and "Lojistik A.Ş." in x for t, x in kept)
    assert not any("2019/77" in x or "1.250" in x for _, x in kept)
    assert sum(x == "Ayla Kaynarca" for x in (f.text for f in out.kept)) == 2  # propagated
    places = [(f.start, f.end) for f in out.kept]
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:])) and all(PETITION[f.start : f.end] == f.text for f in out.kept)


def test_round_trip_and_numbers(spark):
    docs = petition(spark).union(spark.createDataFrame([(2, "m", "Ayla Kaynarca ve Sayın Cem Oral"), (3, "m", None), (4, "m", "")], "doc_id long, source string, text string"))
    chosen = rules.of_profile("standart")
    masked = {r.doc_id: r for r in masking.mask_documents(docs, chosen).collect()}
    assert "{{KISI-01}}" in masked[1].masked and "Ayla" not in masked[1].masked and masked[4].masked == "" and masked[3].masked is None
    again = {r.doc_id: r.masked for r in masking.mask_documents(docs.repartition(3), chosen).collect()}
    assert again == {k: r.masked for k, r in masked.items()}
    rows = masking.resolved(docs.withColumnRenamed("source", "matter_id"), chosen).select("doc_id", "matter_id", F.inline("kept"))
    labels = vault.number_values(rows)
    texts = spark.createDataFrame([(1, "m", masked[1].masked.replace("{{KISI-01}}", "{{ Kişi - 1 }}")), (2, "m", "{{KISI-77}}")], "doc_id long, matter_id string, text string")
    assert {r.doc_id: r.unmasked for r in vault.unmask(texts, labels).collect()} == {1: PETITION, 2: "{{KISI-77}}"}
    assert [tuple(r) for r in vault.unknown_labels(texts, labels).collect()] == [(2, "{{KISI-77}}")]
    known = labels.where("label_type = 'KISI' and number = 1")
    later = vault.number_values(rows.where("canonical <> 'berk tanyolaç'"), known.withColumn("number", F.lit(9)))
    assert {r.number for r in later.where("label_type = 'KISI'").collect()} >= {9}


def test_allow_list_and_dictionary(spark):
    docs = spark.createDataFrame([(1, "Sayın Cem Oral, Proje Ufuk ve proje  ufuk")], "doc_id long, text string")
    out = masking.resolved(docs, rules.of_profile("standart"), entries=[("Proje Ufuk", "GIZLI"), ("Cem Oral", "GIZLI")], allow=["Cem Oral"]).first()
    assert [(f.label_type, f.text) for f in out.kept] == [("GIZLI", "Cem Oral"), ("GIZLI", "Proje Ufuk"), ("GIZLI", "proje  ufuk")]
    out = masking.resolved(docs, rules.of_profile("standart"), allow=["Cem Oral"]).first()
    assert out.kept == []
    with pytest.raises(ValueError):
        rules.of_profile("other")


def test_greedy_resolution(spark):
    rng = random.Random(2)
    cases = [[(a, a + rng.randint(1, 6), rng.choice([50, 60, 70])) for a in (rng.randint(0, 20) for _ in range(8))] for _ in range(20)]
    rows = [(i, [(a, b, "E", "T", s, "t", f"{a}-{b}", "r") for a, b, s in c]) for i, c in enumerate(cases)]
    out = spark.createDataFrame(rows, f"i int, c {rules.FINDINGS}").select("i", resolve.resolve(F.col("c")).alias("k")).collect()
    for r in out:
        kept = []
        for a, b, s in sorted(cases[r.i], key=lambda x: (-x[2], x[0] - x[1], x[0], f"{x[0]}-{x[1]}")):
            if all(b <= x or y <= a for x, y, _ in kept):
                kept.append((a, b, s))
        assert [(f.start, f.end, f.score) for f in r.k] == sorted(kept)


def test_scans(spark):
    docs = spark.createDataFrame([(1, "ok\nThis is a TRADE SECRET\nand without prejudice\ntrade secret"), (2, "12345678901 {{KISI-01}}\n a@b.example")], "doc_id long, text string")
    assert sorted((r.category, r.lines, r.sample) for r in scan.red_lines(docs).collect()) == [("settlement", [3], "without prejudice"), ("trade_secret", [2, 4], "TRADE SECRET")]
    assert sorted((r.category, r.line) for r in scan.residual(docs, "text").where("doc_id = 2").collect()) == [("10 digits", 1), ("11 digits", 1), ("e-mail", 2)]


def test_suffixes(spark):
    rows = [
        ("Ankara", "in", "nın"), ("Mehmet", "ı", "i"), ("Özgür", "da", "de"), ("Ahmet", "den", "ten"), ("Ayşe", "a", "ye"), ("Ali", "la", "yle"), ("Su", "xyz", "xyz"), ("Can", "", ""),
        ("Ayşe KARA", "in", "nın"), ("Ali VURAL", "ye", "a"), ("Ali Vural", "lerinde", "larında"), ("İstanbul", "deki", "daki"), ("Okul", "nin", "un"), ("Ayşe KARA", "ıyormuş", "ıyormuş"),
        ("12345678950", "in", "in"), ("ABC Enerji A.Ş.", "nin", "nin"), ("", "in", "in"), ("Ali", None, None),
    ]
    df = spark.createDataFrame(rows, "word string, suffix string, want string").withColumn("got", inflected(F.col("word"), F.col("suffix")))
    assert [(r.word, r.suffix, r.got) for r in df.collect()] == [(w, s, want) for w, s, want in rows]


def test_unmask_with_endings(spark):
    labels = spark.createDataFrame([("m", "{{KİŞİ-01}}", ["Ayşe KARA"]), ("m", "{{KİŞİ-02}}", ["Ali VURAL"])], "matter_id string, label string, values array<string>")
    text = "{{KİŞİ-01}}'in talebi {{ KISI-2 }}'ye iletildi; {{KİŞİ-02}}’nin cevabı, {{KİŞİ-09}}'un"
    texts = spark.createDataFrame([(1, "m", text), (2, "m", None)], "doc_id long, matter_id string, text string")
    got = {r.doc_id: r.unmasked for r in vault.unmask(texts, labels).collect()}
    assert got == {1: "Ayşe KARA'nın talebi Ali VURAL'a iletildi; Ali VURAL’ın cevabı, {{KİŞİ-09}}'un", 2: None}


def test_gold_and_scores(spark):
    lines = spark.createDataFrame([(1, "{{KISI|Ayla K}} wrote to {{EPOSTA|a@b.example}}."), (2, "# left out"), (3, "none")], "line_id int, text string")
    gold = evaluate.gold(lines)
    rows = {r.line_id: r for r in gold.collect()}
    assert set(rows) == {1, 3} and rows[1].plain == "Ayla K wrote to a@b.example."
    assert [rows[1].plain[s.start : s.end] for s in rows[1].spans] == ["Ayla K", "a@b.example"]
    kept = masking.resolved(gold.withColumnRenamed("plain", "text"), [r for r in rules.RULES if r.name == "email"])
    assert {r.label_type: (r.gold, r.leaked, r.found, r.right) for r in evaluate.scores(kept).collect()} == {"KISI": (1, 1, 0, 0), "EPOSTA": (1, 0, 1, 1)}
