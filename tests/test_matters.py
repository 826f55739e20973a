import pytest
import random
import io
import re
import zipfile

from pyspark.sql import functions as F

from docveil.operators import coreference, matters
from docveil.sources import files, rewrite


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_numbers_and_names(spark):
    wanted = spark.createDataFrame([("m", 1, 1), ("m", 2, 2), ("n", 1, 3)], "matter_id string, created int, id int")
    taken = spark.createDataFrame([("m", 1), ("m", 3)], "matter_id string, number int")
    assert {(r.id, r.number) for r in matters.free_numbers(wanted, taken).collect()} == {(1, 2), (2, 4), (3, 1)}
    names = spark.createDataFrame([("m", 1, 1, "a"), ("m", 2, 2, "a"), ("m", 3, 3, "x" * 90)], "matter_id string, created int, id int, name string")
    assert {r.id: r.unique_name for r in matters.unique_names(names).collect()} == {1: "a", 2: "a (2)", 3: "x" * 80}


def test_sets(spark):
    a = spark.createDataFrame([("p", "T"), ("q", "T")], "phrase string, type string")
    b = spark.createDataFrame([("q", "U"), ("r", "U"), ("r", "U")], "phrase string, type string")
    assert rows(matters.set_if_absent(a, b, ["phrase"])) == [("p", "T"), ("q", "T"), ("r", "U")]
    assert rows(matters.extra(b.select("phrase"), a.select("phrase"))) == [("r",), ("r",)]


def test_seal(spark):
    df = spark.createDataFrame([("Ayşe",), (None,)], "v string").withColumn("k", F.lit("0123456789abcdef"))
    out = df.select("v", matters.sealed(F.col("v"), F.col("k")).alias("s"), "k").select("v", "s", matters.opened(F.col("s"), F.col("k")).alias("o")).collect()
    assert all(r.v == r.o and (r.s is None or "Ay" not in r.s) for r in out)


def test_overview_report_revision(spark):
    docs = spark.createDataFrame([("m", 1), ("m", 2)], "matter_id string, created int")
    assert rows(matters.overview(docs, spark.createDataFrame([("n",)], "matter_id string"))) == [("m", 2, 0, 2), ("n", 0, 1, None)]
    f = spark.createDataFrame([(1, "KISI"), (1, "KISI"), (1, "IP")], "doc_id int, label_type string")
    s = spark.createDataFrame([(1, 4, "VKN", "123")], "doc_id int, start int, label_type string, text string")
    text = matters.report(f, s).first().report
    assert text.index("| KISI | 2 |") < text.index("| IP | 1 |") and "- VKN: 123" in text
    texts = spark.createDataFrame([(1, "a (b) a")], "doc_id int, text string")
    rev = spark.createDataFrame([(1, "(b)", "c", False), (1, "a", "c", False), (1, "a", "c", True), (1, "x", "c", False), (1, "", "c", False), (1, "b", "c\n", False), (2, "b", "c", False)], "doc_id int, old string, new string, all boolean")
    assert [r.status for r in matters.revise(texts, rev).orderBy("doc_id", "old", "all", "new").collect()] == ["empty", "applied", "ambiguous", "applied", "line-break", "not-found", "not-found"]


def test_coreference(spark):
    vault = spark.createDataFrame(
        [("m", "KISI", "ayla kaynarca", "{{KISI-01}}"), ("m", "KISI", "cem oral", "{{KISI-02}}"), ("m", "KISI", "can oral", "{{KISI-03}}"), ("m", "SIRKET", "mavi deniz lojistik", "{{SIRKET-01}}")],
        "matter_id string, label_type string, canonical string, label string",
    )
    values = [("m", "KISI", v) for v in ("ayla kaynarca", "kaynarca", "oral", "ayla b. kaynarca", "yeni biri")] + [("m", "SIRKET", "mavi deniz"), ("n", "KISI", "kaynarca")]
    out = {(r.matter_id, r.canonical): (r.label, r.how) for r in coreference.known_labels(spark.createDataFrame(values, "matter_id string, label_type string, canonical string"), vault).collect()}
    assert out == {("m", "ayla kaynarca"): ("{{KISI-01}}", "exact"), ("m", "kaynarca"): ("{{KISI-01}}", "last name"), ("m", "ayla b. kaynarca"): ("{{KISI-01}}", "first and last name"), ("m", "mavi deniz"): ("{{SIRKET-01}}", "company")}


def test_udf_offsets_move():
    text = "ilk 😀 satır\nAyşe Kaya geldi\nson"
    a = text.index("Ayşe Kaya")
    raw = rewrite.udf_edited(files.udf_package(text), [(a, a + 9, "{{KISI-01}}"), (0, 3, "İ")])
    fresh, _ = files.udf_text(raw)
    assert fresh == "İ 😀 satır\n{{KISI-01}} geldi\nson"
    xml = zipfile.ZipFile(io.BytesIO(raw)).read("content.xml").decode()
    spans = [(int(x), int(y)) for x, y in re.findall(r'startOffset="(\d+)" length="(\d+)"', xml)]
    wide = fresh.encode("utf-16-le")
    assert "".join(wide[2 * x : 2 * (x + y)].decode("utf-16-le") for x, y in spans) == fresh
    assert files.udf_text(rewrite.udf_edited(files.udf_package(text), []))[0] == text


def test_docx_edits():
    raw = files.docx_package("Sayın **Ayşe** Kaya & Co")
    back = rewrite.docx_edited(raw, [(6, 15, "{{KISI-01}}")])
    assert files.docx_text(back)[0].strip() == "Sayın {{KISI-01}} & Co"
    assert files.docx_text(rewrite.docx_edited(raw, []))[0] == files.docx_text(raw)[0]


NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TRACKED = f"""<w:document xmlns:w="{NS}"><w:body><w:p><w:r><w:t a=">">Bora</w:t></w:r><w:r><w:tab/><w:t> Tek</w:t></w:r></w:p>
<w:p><w:del w:author="Ali"><w:r><w:delText>Secret Ada</w:delText></w:r></w:del><w:r><w:instrText>MAILTO x</w:instrText><w:t/></w:r></w:p></w:body></w:document>"""


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", xml)
    return out.getvalue()


def test_deleted_text_and_other_prefixes_are_edited():
    raw = package(word__document=TRACKED, word__header1=f'<x:hdr xmlns:x="{NS}"><x:p><x:r><x:t>Head &amp; co</x:t></x:r></x:p></x:hdr>', docProps__core="<p><dc:creator>Ali</dc:creator><z>k</z></p>")
    text, warnings = files.docx_text(raw)
    assert text == "Bora\t Tek\nSecret Ada\nHead & co" and warnings == ["tracked changes"]
    back = rewrite.docx_edited(raw, [(text.index("Secret"), text.index("Secret") + 10, "{{K-1}}"), (0, 9, "{{K-2}}"), (text.index("Head"), text.index("Head") + 6, "<&")])
    assert files.docx_text(back)[0] == "{{K-2}}\t\n{{K-1}}\n<& co"
    whole = b"".join(zipfile.ZipFile(io.BytesIO(back)).read(n) for n in zipfile.ZipFile(io.BytesIO(back)).namelist())
    assert b"Ali" not in whole and b"Secret" not in whole and b"MAILTO" not in whole and b"<z>k</z>" in whole
    for bad in ([(0, 3, "a"), (2, 5, "b")], [(0, 99, "a")], [(4, 5, "only a tab")]):
        with pytest.raises(files.Unreadable):
            rewrite.docx_edited(raw, bad)


def test_udf_of_several_sections():
    raw = package(content='<?xml version="1.0"?><template><content><![CDATA[ one]]> mid &amp; <![CDATA[two]]>\r\nx\ry</content><elements><c length="4" startOffset="0"/><c startOffset="4" length="3"/></elements></template>')
    assert files.udf_text(raw)[0] == " one mid & two\nx\ny"
    xml = zipfile.ZipFile(io.BytesIO(rewrite.udf_edited(raw, [(1, 4, "four")]))).read("content.xml").decode()
    assert '<c length="5" startOffset="0"/><c startOffset="5" length="3"/>' in xml
    for text in ("a]]>b", "  lead\nx", "", " \n"):
        assert files.udf_text(files.udf_package(text))[0] == text
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("ab😀\n<&]>é ") for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.sample(range(len(s) + 1), min(len(s) + 1, 2 * rng.randint(0, 3)) // 2 * 2))
        edits = [(a, b, rng.choice(["", "Z", "😀]]>"])) for a, b in zip(cuts[::2], cuts[1::2])]
        want = s
        for a, b, r in reversed(edits):
            want = want[:a] + r + want[b:]
        assert files.udf_text(rewrite.udf_edited(files.udf_package(s), edits))[0] == want


def test_packages_as_tables(spark):
    rows = [("a.udf", bytearray(files.udf_package("Ali 1"))), ("b.docx", bytearray(package(word__document=TRACKED))), ("c.txt", bytearray(b"Ali")), ("d.docx", bytearray(b"broken")), ("e.txt", bytearray(b"as it is"))]
    edits = [("a.udf", 0, 3, "X"), ("b.docx", 10, 20, "Y"), ("c.txt", 2, 9, "Z")]
    out = {r.path: r for r in rewrite.packages(spark.createDataFrame(rows, "path string, content binary"), spark.createDataFrame(edits, "path string, start int, end int, replacement string")).collect()}
    assert files.udf_text(bytes(out["a.udf"].content))[0] == "X 1" and "Secret" not in files.docx_text(bytes(out["b.docx"].content))[0]
    assert out["c.txt"].content is None and out["c.txt"].error and out["d.docx"].content is None and bytes(out["e.txt"].content) == b"as it is"
