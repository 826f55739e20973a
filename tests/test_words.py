from docveil.operators import filters, gate, scan


def test_dictionary_whole_words(spark):
    docs = spark.createDataFrame([(1, "the cats; THE CAT, the cat"), (2, "東京 日本語 x"), (3, "a -- b"), (4, None), (5, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([("the cat",), ("he cat",), ("日本語",), ("--",), (" ",), (None,)], "phrase string")
    want = {(1, "the cat", 2), (2, "日本語", 1), (3, "--", 1)}
    assert {tuple(r) for r in filters.dictionary_join(docs, phrases).collect()} == want
    assert {tuple(r) for r in filters.dictionary_join(docs, phrases, limit=0).collect()} == want


def test_shared_names(spark):
    values = spark.createDataFrame([("m", "KISI", "{{KISI-01}}", "Mehmet Kara"), ("m", "KISI", "{{KISI-02}}", "Ali Kara"), ("m", "KISI", "{{KISI-03}}", "Ayşe Demir")], "matter_id string, label_type string, label string, value string")
    texts = spark.createDataFrame([(1, "m", "Kara yolu ve kara tahta; ALI KARA"), (2, "m", "demir yolu, Demir Hanım")], "out_id long, matter_id string, text string")
    got = {r.out_id: r for r in gate.gate(texts, values).collect()}
    assert got[1].cleaned == "Kara yolu ve kara tahta; {{KISI-02}}" and got[1].hits == 1
    assert got[2].cleaned == "demir yolu, {{KISI-03}} Hanım"


def test_residual_edges(spark):
    texts = ["1234567890123456", "12345678901", "xTR" + "1" * 24, "0532 123", "10532123", "1234567890/12", "1.1234567890", "TR12 3456 7890 1234", "+90 532", "02345678901", "1234567890."]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, masked string")
    want = {(2, "10 digits"), (2, "11 digits"), (4, "mobile"), (8, "iban"), (9, "mobile"), (10, "10 digits"), (11, "10 digits")}
    assert {(r.doc_id, r.category) for r in scan.residual(docs).collect()} == want


def test_long_texts_are_not_copied_for_each_word(spark):
    text = " ".join(f"w{i}" for i in range(40_000)) + " The Long Phrase, here."
    docs = spark.createDataFrame([(i, text) for i in range(4)] + [(4, None), (5, "long phrases")], "doc_id long, text string")
    phrases = spark.createDataFrame([("the long phrase",), ("a longish thing",), (", here",)], "phrase string")
    want = {(i, p, 1) for i in range(4) for p in ("the long phrase", ", here")}
    for limit in (10, 0):
        got = filters.dictionary_join(docs, phrases, limit=limit)
        assert {tuple(r) for r in got.collect()} == want
    plan = filters.dictionary_join(docs, phrases)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(filter(" in plan
