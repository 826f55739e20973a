import datetime
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docveil.functions.textfold import NUMBERS
from docveil.operators import audit, diff, egress, gate, pages
from docveil.sources import files


VALUES = [("m", "KISI", "{{KISI-01}}", "Ayşe Gündoğdu"), ("m", "TELEFON", "{{TELEFON-01}}", "0532 111 22 33"), ("m", "IBAN", "{{IBAN-01}}", "TR330006100519786457841326"), ("n", "KISI", "{{KISI-01}}", "Bora Tek")]


@pytest.mark.parametrize("text, label", [
    ("dear AYŞE GÜNDOĞDU", "{{KISI-01}}"), ("ayse  gundogdu", "{{KISI-01}}"), ("Ayşe Gündoğdu", "{{KISI-01}}"),
    ("Ay­şe Gün​doğdu", "{{KISI-01}}"), ("Ayşe Gün-\ndoğdu", "{{KISI-01}}"), ("A. Gündoğdu", "{{KISI-01}}"),
    ("call +90 (532) 111-22-33", "{{TELEFON-01}}"), ("TR33 0006 1005 1978 6457 8413 26", "{{IBAN-01}}"), ("Ａyşe Gündoğdu", "{{KISI-01}}"),
    ("Bora Tek", None), ("nothing", None), ("05321112233444", None), (None, None),
])
def test_gate(spark, text, label):
    out = gate.gate(spark.createDataFrame([(1, "m", text)], "out_id long, matter_id string, text string"), spark.createDataFrame(VALUES, "matter_id string, label_type string, label string, value string")).collect()
    assert [r.label for r in out] == ([label] if label else [])
    if label:
        assert label in out[0].cleaned


def test_gate_meets_only_what_a_text_may_show(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [("TELEFON", "053" + digits(8)) for _ in range(9)] + [("TCKN", digits(11)) for _ in range(9)] + [("KISI", f"{a} {b}") for a in ("Ali", "Ece_Su", "Can") for b in ("Kaya", "Ak", "Öz-Tan")] + [("SICIL_NO", "ab-" + digits(5)), ("SIRKET", "Ak_Su A.S.")]
    for t, v in values * 20:
        shown = rng.choice(gate.name_forms(t, v))
        if t in NUMBERS:
            shown = "".join(c + rng.choice(["", "", "", " ", "-", ". "]) for c in v)
            if t == "TELEFON":
                shown = rng.choice(["+90 ", "90", "0090-", "0", ""]) + shown[1:].lstrip(" -.")
        text = rng.choice(["", "x ", "_", "é", "12 "]) + shown.replace(" ", rng.choice([" ", "_", "\n", ", "])) + rng.choice(["", ".", "_", " 7"])
        for f in gate.name_forms(t, v):
            if egress.Scanner([(f, t, "x")]).scan(text):
                assert egress.keys_of(t, f) <= egress.pieces(text), (t, f, text)
    many = [("m", "KISI", f"{{{{KISI-{i}}}}}", f"Ali Soyad{i}") for i in range(500)]
    texts = [(i, "m", f"Ali Soyad{i} was here") for i in range(50)] * 2
    out = gate.gate(spark.createDataFrame(texts, "out_id long, matter_id string, text string"), spark.createDataFrame(many, "matter_id string, label_type string, label string, value string"))
    assert sorted((r.label, r.hits, r.cleaned) for r in out.collect()) == sorted([(f"{{{{KISI-{i}}}}}", 1, f"{{{{KISI-{i}}}}} was here") for i in range(50)] * 2)


def test_chunks_and_pages(spark):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 120)))
        spans = sorted((a, a + rng.randint(1, 6)) for a in rng.sample(range(120), 3))
        spans = [s for i, s in enumerate(spans) if s[1] <= len(text) and (i == 0 or spans[i - 1][1] <= s[0])]
        parts = pages.cuts(text, 20, spans)
        assert "".join(text[a:b] for a, b in parts) == text
        assert all(not any(a < e < b for a, b in spans) for _, e in parts)
        assert all(b - a <= 20 or (a, b) in spans for a, b in parts)
    items = [("g", i, n) for i, n in enumerate([3, 4, 9, 1, 1, 20, 5])] + [("h", 0, 50)]
    out = pages.paginate(spark.createDataFrame(items, "g string, i int, n int"), 10, "g", "i", "n")
    assert [r.page for r in out.where("g = 'g'").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4, 5] or [r.page for r in out.where("g = 'g'").orderBy("i").collect()] == [1, 1, 2, 2, 3, 3, 4]


CONTRACT = """1. Definitions
"Service Levels" means the agreed levels. "Unused Thing" means nothing.
2. Scope
The Supplier meets the service levels under section 2.1 and section 9.9.
2.1 Details
Mavi Deniz A.Ş. and later Mavi Deniz Ltd. Şti. sign."""


def test_contract(spark):
    rows = audit.paragraphs(spark.createDataFrame([(1, CONTRACT), (2, None), (3, "plain section 4")], "doc_id long, text string")).cache()
    assert all(CONTRACT[r.start :].startswith(r.text) for r in rows.where("doc_id = 1").collect())
    assert {r.term for r in audit.defined_terms(rows).collect()} == {"Service Levels", "Unused Thing"}
    assert [r.term for r in audit.unused_terms(rows).collect()] == ["Unused Thing"]
    assert [r.path for r in audit.missing_references(rows).collect()] == ["9.9"]
    assert [(r.core, r.forms) for r in audit.party_forms(rows).collect()] == [("mavi deniz", ["A.Ş.", "Ltd. Şti."])]


def test_numbers_dates_languages(spark):
    cases = [("1.234,56", "1234.5600"), ("1,234.56", "1234.5600"), ("1.234.567", "1234567.0000"), ("12", "12.0000"), ("3,5", "3.5000"), ("1 250,00", "1250.0000"), ("x", None), ("", None)]
    got = spark.createDataFrame(cases, "t string, w string").select("t", "w", audit.number(F.col("t")).cast("string").alias("g")).collect()
    assert all(r.g == r.w for r in got), got
    d = datetime.date
    dates = [("2021-03-04", d(2021, 3, 4)), ("04.03.2021", d(2021, 3, 4)), ("12/25/2020", d(2020, 12, 25)), ("4 Mart 2021", d(2021, 3, 4)), ("March 4, 2021", d(2021, 3, 4)), ("31.02.2021", None), ("soon", None)]
    got = spark.createDataFrame([(t,) for t, _ in dates], "t string").select("t", audit.date(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in got} == dict(dates)
    cells = [(1, 0, "left", "04.03.2021 ve 1.250,00 TL"), (1, 0, "right", "March 4, 2021 and 1,250.00 TL"), (1, 1, "left", "10,50"), (1, 1, "right", "10.60")]
    out = audit.bilingual_differences(spark.createDataFrame(cells, "doc_id int, row int, side string, text string")).collect()
    assert sorted((r.row, r.side, r.value) for r in out) == [(1, "left", "10.5000"), (1, "right", "10.6000")]


@pytest.mark.parametrize("seed", range(20))
def test_version_law(seed):
    """Without what is added the markup is the old text, without what is deleted the new one."""
    rng = random.Random(seed)
    blocks = [" ".join(rng.choice(["alpha", "beta", "gamma", "12,5", "{{KISI-01}}"]) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    new = [b if rng.random() < 0.5 else b + " delta" for b in blocks if rng.random() < 0.8] + ["entirely other words here"]
    changes = diff.aligned(blocks, new)
    assert [i for _, i, _ in changes if i is not None] == list(range(len(blocks)))
    assert [j for _, _, j in changes if j is not None] == list(range(len(new)))
    for _, i, j in changes:
        x, y = blocks[i] if i is not None else "", new[j] if j is not None else ""
        parts = diff.word_changes(x, y)
        assert "".join(a for _, a, _ in parts) == x and "".join(b for _, _, b in parts) == y


@pytest.mark.parametrize("seed", range(5))
def test_pairs_add_up_to_the_most(seed):
    """Against every chain, by a table over both sides."""
    rng = random.Random(seed)
    for _ in range(150):
        say = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 4)))
        a = [say() for _ in range(rng.randint(0, 7))]
        b = [say() if rng.random() < 0.5 or not a else rng.choice(a) for _ in range(rng.randint(0, 7))]
        like = [[diff.alike(diff.bag(x), diff.bag(y)) for y in b] for x in a]
        most = {(i, j): 0.0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                own = like[i - 1][j - 1]
                most[i, j] = max(most[i - 1, j], most[i, j - 1], most[i - 1, j - 1] + own if own >= diff.BLOCK else 0)
        pairs = diff.paired(a, b)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert abs(sum(like[i][j] for i, j in pairs) - most[len(a), len(b)]) < 1e-9


def test_long_regions_and_tables():
    old = [f"clause {i} says {i * 7} and {i * 13} words" for i in range(600)]
    new = ["an inserted clause of its own", *(x + " more" for x in old)]
    assert diff.aligned(old, new)[0] == ("added", None, 0) and all(k == "changed" and j == i + 1 for k, i, j in diff.aligned(old, new)[1:])
    rows = diff.table_changes([["a b c", "1"], ["d e f", "2"]], [["a b c", "9", "new"], ["x y z", "7"]])
    assert rows[0] == ("changed", 0, 0, [("changed", 1), ("added", 2)]) and {r[0] for r in rows[1:]} == {"deleted", "added"}


def test_compare(spark):
    old = spark.createDataFrame([(1, 0, "same"), (1, 1, "the old text of it"), (2, 0, "gone")], "pair_id long, block_idx int, text string")
    new = spark.createDataFrame([(1, 0, "same"), (1, 1, "the new text of it"), (1, 2, "more")], "pair_id long, block_idx int, text string")
    out = diff.compare(old, new)
    assert sorted((r.pair_id, r.kind) for r in out.collect()) == [(1, "added"), (1, "changed"), (1, "equal"), (2, "deleted")]
    assert out.where("kind = 'changed'").first().markup == "the [-old-]{+new+} text of it"
    assert diff.change_counts(out).where("pair_id = 1").first().changed == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é😀")
    (tmp_path / "b.udf").write_bytes(files.udf_package("bir\n😀 iki ]> & son"))
    (tmp_path / "c.docx").write_bytes(files.docx_package("# Head\n- item **bold** & more"))
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.doc").write_bytes(b"x")
    out = {r.path.rpartition("/")[2]: r for r in files.read(spark, str(tmp_path)).collect()}
    assert out["a.txt"].text == "plain é😀" and out["b.udf"].text == "bir\n😀 iki ]> & son"
    assert out["c.docx"].text.split("\n")[:2] == ["Head", "• item bold & more"]
    assert out["d.docx"].text is None and out["d.docx"].error == "not an archive" and out["e.doc"].error == "the old binary format; save it as docx"
    content = zipfile.ZipFile(io.BytesIO(files.udf_package("😀\nx"))).read("content.xml").decode()
    assert 'startOffset="0" length="3"' in content and 'startOffset="3" length="1"' in content
    md = "# T\n| a | b |\n|---|---|\n| c | d |\n* x **y**"
    assert spark.createDataFrame([(md,)], "t string").select(files.flattened(F.col("t")).alias("x")).first().x == "T\na    b\nc    d\n• x y"


def test_label_stream(spark, tmp_path):
    from docveil.streaming import labels

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "matter_id string, doc_id long, start int, label_type string, canonical string"
    source = tmp_path / "in"
    batches = [[("m", 2, 5, "KISI", "b"), ("m", 1, 9, "KISI", "a"), ("n", 1, 0, "KISI", "a")], [("m", 3, 0, "KISI", "a"), ("m", 3, 4, "KISI", "c"), ("m", 3, 8, "IBAN", "x")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = labels.label_stream(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("m", "IBAN", "x", 1), ("m", "KISI", "a", 1), ("m", "KISI", "b", 2), ("m", "KISI", "c", 3), ("n", "KISI", "a", 1)]
