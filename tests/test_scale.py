"""What keeps the cost of a row from growing: one pass for matches, few rows at a time in Python."""

from pyspark.sql import functions as F

from docveil.functions import jsons
from docveil.operators import audit, batches, diff, egress, evaluate, gate, masking, match, reports, review, rules, staging


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_marked_in_one_pass(spark):
    texts = ["a12b3", "12", "", "none", None, "x788", "1 ı 22 😀 333", "$1\\2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [[(1, 3, "12"), (4, 5, "3")], [(0, 2, "12")], [], [], [], [(2, 3, "7"), (4, 6, "88")], [(0, 1, "1"), (4, 6, "22"), (9, 12, "333")], [(1, 2, "1"), (3, 4, "2")]]
    for found in (match.spans(F.col("t"), "[0-9]+"), F.expr(match.spans_sql("t", "[0-9]+"))):
        assert [[tuple(x) for x in r.f or []] for r in df.select(found.alias("f")).collect()] == want
    # the split at a pattern, which is compiled for each text, is left to texts that hold the mark
    assert "split(regexp_replace(t#" in _plan(df.repartition(1).select(match.spans(F.col("t"), "[0-9]+").alias("f")))


def test_dates_fold_their_text_once(spark):
    df = spark.createDataFrame([("5 Mayıs 2024",), ("2024-01-02\n",), ("13.02.2024",), ("02/13/2024",), ("2024-13-01",)], "t string").select(audit.date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in df.collect()] == ["2024-05-05", "2024-01-02", "2024-02-13", "2024-02-13", None]
    assert _plan(df.repartition(1).select("d")).count("lower(") <= 1


def test_python_holds_few_rows(spark):
    df = spark.range(0, 1000, 1, 1)
    seen = batches.mapped(df, lambda ids: [(i, len(ids)) for i in ids if i % 3], "i bigint, n int")
    rows = seen.toPandas()
    assert rows["i"].tolist() == [i for i in range(1000) if i % 3] and rows["n"].max() == batches.ROWS
    assert batches.mapped(df, lambda ids: [], "i bigint").count() == 0


def test_audit_shuffles_no_texts(spark):
    docs = staging.spread(spark.range(100).withColumnRenamed("id", "doc_id"), "doc_id").withColumn("text", F.lit("“Alpha Works” and “Ox” are. An Ox and oxen.\nAlpha Worksites there, Alpha Works"))
    rows = audit.paragraphs(docs)
    assert audit.unused_terms(rows).count() == 0
    assert [r.term for r in audit.unused_terms(rows.withColumn("text", F.expr("replace(text, 'An Ox')"))).select("term").distinct().collect()] == ["Ox"]
    found = audit.unused_terms(rows)
    found.collect()
    assert "__run" not in _plan(found) and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert reports.audit_findings(docs).count() == 0


def test_values_that_begin_alike_do_not_meet_a_text(spark):
    values = spark.createDataFrame([(1, "IBAN", f"{{{{IBAN-{i}}}}}", f"TR33 0006 1005 1978 {i:07}") for i in range(300)], "matter_id long, label_type string, label string, value string")
    texts = spark.createDataFrame([(i, 1, f"to 33000610051978{i:07}.") for i in range(20)] + [(99, 1, "3300061005197")], "out_id long, matter_id long, text string")
    rows = texts.withColumn("digest", F.sha2("text", 256))
    near = gate.near_values(rows, gate.value_forms(values)).collect()
    assert len(near) == 20 and all(len(r.near) == 1 for r in near)
    shown = lambda sent: sorted(map(tuple, gate.gate(texts, values, sent).collect()))
    assert shown(0) == shown(1000) and len(shown(0)) == 20


def test_keys_of_all_lengths_are_met():
    keys = ["abc", "abcd", "abcdef", "x" * 12, "y" * 13, "z" * 40, "ab"]
    begun = {b for k in keys for b in egress.beginnings(k)}
    told = lambda known: lambda found: [k in known for k in found]
    for k in keys:
        got = egress.met(f"1 {k[0]}-{k[1:]}.", sorted(set(map(len, keys))), told(begun), told(set(keys)))
        assert k in got and set(got) <= set(keys)
    assert egress.met("abx zz", [2, 3, 40], told(begun), told(set(keys))) == ["ab"]


def test_scores_read_their_rows_once(spark):
    df = spark.createDataFrame([(1, [(0, 4, "KISI"), (9, 12, "KISI")], [(2, 5, "EPOSTA")]), (2, [], [(1, 2, "IP")]), (3, None, None)], "id int, spans array<struct<start: int, end: int, label_type: string>>, kept array<struct<start: int, end: int, label_type: string>>")
    got = evaluate.scores(df)
    assert {tuple(r) for r in got.collect()} == {("KISI", 2, 1, 0, 0), ("EPOSTA", 0, 0, 1, 0), ("IP", 0, 0, 1, 0)}
    assert _plan(got).count("LogicalRDD") + _plan(got).count("LocalRelation") == 1


def test_texts_are_searched_only_if_they_may_match(spark):
    """Every gate of a rule has a hint or is one itself, and lets pass what the rule needs."""
    assert {r.needs for r in rules.RULES if r.needs} - set(rules.HINTS) == {rules.GIVEN_GATE}
    made = ["Av. A. Kara", "12 Long Street", "rue de Lyon 4", "34 ABC 12", "TR33 0006 1005 1978 6457 8413 26", "Davalı: Ali Kara", "DAVACI Ali Kara", "WITNESS: John Smith", "Date of Birth: 1.2.1990", "1990 doğumlu", "Doğum yılı: 1990", "Ali ve Ayşe OĞLU",
        "Ali ve Ayşe Kızı", "ADRES: Uzun yol 5", "Sayı: 12ab-3", "Ankara 3. Asliye Hukuk Mahkemesi", "~Ali:", "] Ali:", "ABCD", "J. R. Roe", "J.R.", "j@x.example", "10.0.0.1", "Mavi A.Ş.", "Mavi AŞ", "Mavi LTD. ŞTİ.", "Uzun Mah. No: 4", "Mrs. Roe", "KIŞ", "İ. Ö.", "", "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "id int, text string").repartition(1)
    alone = F.concat(*(rules.found("text", r) for r in rules.RULES))
    want = {r.id: sorted((f.start, f.end, f.source) for f in r.f or []) for r in df.select("id", alone.alias("f")).collect()}
    got = {r.id: sorted((f.start, f.end, f.source) for f in r.candidates) for r in rules.detect(df, rules.RULES).collect()}
    assert got == want and sum(map(len, got.values())) > 20
    low = lambda n: n in rules.ANY_CASE
    hit = lambda n: " or ".join(f"text rlike {match.literal(h)}" if h in rules.SHARED else f"contains({'lower(text)' if low(n) else 'text'}, {match.literal(h)})" for h in rules.HINTS[n])
    for n in rules.HINTS:
        assert df.where(F.col("text").rlike(n) & ~F.expr(hit(n))).count() == 0, n


def test_unmarked_comparison_compares_no_words(spark, monkeypatch):
    rows = lambda *b: spark.createDataFrame([(k, i, t) for k, i, t in b], "pair_id long, block_idx int, text string")
    old, new = rows((1, 5, "one two three"), (1, 2, "a  b"), (2, 0, "gone"), (4, 1, None)), rows((1, 0, "a b"), (1, 9, "one two four"), (3, 7, "new {{K-1}}  x"), (4, 1, ""))
    marked = diff.compare(old, new)
    assert sorted(map(tuple, marked.drop("markup").collect())) == sorted(map(tuple, diff.compare(old, new, marked=False).collect()))
    assert {(r.pair_id, r.position, r.kind, r.old_block, r.new_block) for r in marked.collect()} == {(1, 0, "equal", 2, 0), (1, 1, "changed", 5, 9), (2, 0, "deleted", 0, None), (3, 0, "added", None, 7), (4, 0, "equal", 1, 1)}
    assert diff.plain(" a \n{{X  Y}}\t b ") == "a {{X  Y}} b" and diff.plain(" a  b") == "a b"


def test_strings_of_json_are_parted_once(spark):
    df = spark.createDataFrame([('{"a": ["x\\"y", "z"], "b\\u0041": ""}',), ('["plain", 1, "é\\n"]',)], "j string").repartition(1)
    got = df.select(jsons.mapped(F.col("j"), lambda x: F.concat(x, F.lit("!"))).alias("m"))
    assert [r.m for r in got.collect()] == ['{"a!": ["x\\"y!", "z!"], "bA!": "!"}', '["plain!", 1, "é\\n!"]']
    assert _plan(got).count("split(regexp_replace(") == 1


def _joined(df):
    """For each part of a union, whether it is joined with anything."""
    parts = df._jdf.queryExecution().optimizedPlan().children()
    return ["Join" in parts.apply(i).toString() for i in range(parts.size())]


def test_only_texts_with_findings_or_labels_meet_others(spark):
    made = {1: "to a@b.example and 10.0.0.1", 2: "nothing", 3: None, 4: "again a@b.example, 10.0.0.999", 5: "{{EPOSTA-1}}'den {{ IP - 01 }} {{X-7}}{{X-7}} {{A-1", 6: "", 7: "{{no label}}"}
    docs = spark.createDataFrame([(i, "m", t) for i, t in made.items()], "doc_id long, source string, text string").repartition(2)
    masked = masking.mask_documents(docs, [r for r in rules.RULES if r.name in ("email", "ip")])
    assert {r.doc_id: (r.masked, r.n_findings, r.n_suspects) for r in masked.collect()} == {i: (t, 0, 0) for i, t in made.items()} | {1: ("to {{EPOSTA-01}} and {{IP-01}}", 2, 0), 4: ("again {{EPOSTA-01}}, 10.0.0.999", 1, 0)}
    vault = [("m", "EPOSTA", "{{EPOSTA-01}}", ["a@b.example"]), ("n", "IP", "{{IP-01}}", ["10.0.0.1"])]
    labels = spark.createDataFrame(vault, "matter_id string, label_type string, label string, values array<string>")
    back = review.delivered(masked.select("doc_id", "matter_id", F.col("masked").alias("text")), labels)
    want = {i: (t, 0, []) for i, t in made.items()} | {1: ("to a@b.example and {{IP-01}}", 1, ["{{IP-01}}"]), 4: (made[4], 1, []), 5: ("a@b.example'den {{ IP - 01 }} {{X-7}}{{X-7}} {{A-1", 1, ["{{ IP - 01 }}", "{{X-7}}"])}
    assert {r.doc_id: (r.unmasked, r.resolved, r.unknown) for r in back.collect()} == want
    twice = labels.union(labels.withColumn("values", F.array(F.lit("c@d.example"))))
    assert {r.doc_id: (r.unmasked, r.resolved) for r in review.delivered(docs.withColumnRenamed("source", "matter_id"), twice).collect()}[5] == (None, 1)
    assert _joined(masked) == [False, True] and not all(_joined(back))
