import io
import zipfile

import pytest

from docveil.sources import files, markdown
from docveil.sources.files import W, docx_package

NS = f'xmlns:w="{W[1:-1]}"'
LEVELS = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="3"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="decimalZero"/><w:lvlText w:val="%1-%3"/><w:isLgl/></w:lvl><w:lvl w:ilvl="3"><w:numFmt w:val="bullet"/><w:lvlText w:val="o"/></w:lvl>'
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7">{LEVELS}</w:abstractNum><w:abstractNum w:abstractNumId="8"><w:numStyleLink w:val="L"/></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride></w:num><w:num w:numId="3"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
STYLES = f'<w:styles {NS}><w:style w:styleId="L"><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="K"><w:basedOn w:val="L"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="C"><w:basedOn w:val="C"/></w:style></w:styles>'


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def p(text, num=None, level=None, style=None):
    listed = f'<w:numPr>{f"""<w:ilvl w:val="{level}"/>""" if level is not None else ""}<w:numId w:val="{num}"/></w:numPr>' if num is not None else ""
    return f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}<w:tabs><w:tab/></w:tabs>{listed}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_numbers_of_lists():
    body = p("one", 1) + p("two", 1, 1) + p("three", 1, 1) + p("legal", 1, 2) + p("dot", 1, 3) + p("four", style="K") + p("again", 1, 1) + p("over", 2) + p("on", 1) + p("linked", 3) + p("none", 0, style="L") + p("circle", style="C") + p("lost", 5)
    assert markdown.view(package(body, styles=STYLES, numbering=NUMBERING)).split("\n") == [
        "I. one", "I.c) two", "I.d) three", "1-1 legal", "- dot", "## II. four", "II.c) again", "IX. over", "X. on", "XI. linked", "none", "circle", "lost",
    ]


def test_text_and_tables():
    run = lambda t: f"<w:r>{t}</w:r>"
    deleted = f'<w:p><w:del>{run("<w:delText>gone</w:delText>")}</w:del><w:ins>{run("<w:t>a</w:t><w:tab/><w:t>b</w:t>")}</w:ins></w:p>'
    table = f'<w:tbl><w:tr><w:tc>{p("x|y")}{p("z")}</w:tc></w:tr><w:tr><w:tc>{p("")}</w:tc></w:tr><w:tr><w:tc>{p("1")}</w:tc><w:tc>{p("2")}</w:tc></w:tr></w:tbl>'
    got = markdown.view(package(f"<w:sdt><w:sdtContent>{deleted}</w:sdtContent></w:sdt>{p('')}{p('')}{table}{p('Title', style='Title')}"))
    assert got == "a\tb\n\n| x\\|y<br>z |  |\n|---|---|\n| 1 | 2 |\n\n# Title"
    text = "# A\n\nb & <c>\n\n| a\\|b | c<br>d |\n|---|---|\n|  | e |\n\nf"
    assert markdown.view(docx_package(text)) == text and markdown.view(docx_package("")) == ""


def test_counts_as_columns_do(spark):
    from pyspark.sql import functions as F

    from docveil.functions.numerals import formatted

    forms = ["decimal", "decimalZero", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman"]
    rows = spark.range(60).select("id", *(formatted(F.col("id").cast("int"), F.lit(f)).alias(f) for f in forms)).collect()
    assert all(r[f] == markdown.counted(r.id, f) for r in rows for f in forms)


def test_unreadable_packages(spark):
    df = spark.createDataFrame([("a", b"no"), ("b", None), ("c", package(p("x"), styles="<a"))], "path string, content binary")
    assert sorted((r.path, r.markdown, r.error) for r in markdown.views(df).collect()) == [("a", None, "not an archive"), ("b", None, "not an archive"), ("c", None, "word/styles.xml is not XML")]


def test_plain_packages_take_one_pass(monkeypatch):
    text = "## A\n\nb **c** & d\n\n| e | f |\n|---|---|\n| g\\|h | i<br>j |"
    made = docx_package(text)
    z = zipfile.ZipFile(io.BytesIO(made))
    assert z.testzip() is None and z.namelist() == ["[Content_Types].xml", "_rels/.rels", "word/document.xml"]
    monkeypatch.setattr(files.zipfile, "ZipFile", None)  # archives are neither opened to be added to nor to be read
    monkeypatch.setattr(markdown.Lists, "chain", None)  # and styles are asked for headings alone
    assert docx_package(text) == made and markdown.view(docx_package(text.split("\n\n", 1)[1])) == text.split("\n\n", 1)[1].replace("**", "")


@pytest.mark.parametrize("odd", ["comment", "junk before", "stored", "other names"])
def test_odd_archives(odd):
    out = io.BytesIO(b"junk" if odd == "junk before" else b"")
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED if odd == "stored" else zipfile.ZIP_DEFLATED) as z:
        z.comment = b"note" if odd == "comment" else b""
        z.writestr("word/médiå.xml" if odd == "other names" else "x", "x")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{p('one')}</w:body></w:document>")
    assert markdown.view(out.getvalue()) == "one"


def test_damaged_parts():
    raw = package(p("one"))
    at = raw.index(b"document.xml") + 20
    with pytest.raises(files.Unreadable):
        markdown.view(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])
