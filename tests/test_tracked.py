import random
import re

import pytest

from docveil.sources import tracked
from docveil.sources.files import docx_package, docx_text, package_of
from docveil.sources.tracked import APPLIED, CLASHES, CROSSES, EMPTY, HELD, MISSING, SEVERAL, UNSAID, blocks, revised_package, tracked_package


def a_version(rng):
    word = lambda: rng.choice("the buyer pays <a> & b\t of 5,000 EUR within days".split(" "))
    line = lambda: " ".join(word() for _ in range(rng.choice([0, 1, 5, 20])))
    return [line() if rng.random() < 0.8 else [[line() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 8))]


def slipped(rng, blocks):
    out = []
    for b in blocks:
        x = rng.random()
        if x < 0.15:
            continue
        if x < 0.3:
            out.append("a block that is new")
        if isinstance(b, list):
            b = [[c + " more" if rng.random() < 0.3 else c for c in r] for r in b if rng.random() < 0.8] or [["only"]]
        elif x > 0.6:
            b = b.replace("pays", "shall pay").replace("days", "ten days")
        out.append(b)
    return out


def test_both_versions_come_back():
    rng = random.Random(3)
    for k in range(300):
        old = a_version(rng)
        new = slipped(rng, old) if k % 3 else a_version(rng)
        raw, changes = tracked_package(old, new)
        assert blocks(raw, accept=False) == old and blocks(raw, accept=True) == new
        assert (changes == 0) == (old == new)


def test_what_is_equal_is_not_marked():
    raw, changes = tracked_package(["one two three", [["a", "b"], ["c", "d"]]], ["one 2 three", [["a", "b"], ["c", "e"], ["f", "g"]]])
    assert changes == 2 + 2 + 1 + 2  # a word, a cell, and a row of two cells: a deletion and an insertion each, a mark and two texts
    assert blocks(raw)[0] == "one two2 three"


def test_ends_of_paragraphs_and_controls():
    w = "<w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:rPr><w:del w:id='1'/></w:rPr></w:pPr><w:r><w:t>two </w:t></w:r><w:del w:id='2'><w:r><w:delText>2</w:delText></w:r></w:del></w:p><w:sdt><w:sdtContent><w:p><w:moveTo w:id='3'><w:r><w:t>three</w:t></w:r></w:moveTo></w:p></w:sdtContent></w:sdt>"
    raw = package_of(w)
    assert blocks(raw, True) == ["one", "two three"] and blocks(raw, False) == ["one", "two 2", ""] and blocks(raw) == ["one", "two 2", "three"]


def test_revisions_keep_formatting_and_refuse():
    raw = docx_package("The **buyer pays** the price\nwithin ten days, or ten weeks\n# Heading & more")
    asked = [
        ("buyer pays the", "seller gets a", False),
        ("ten", "20", False),
        ("", "x", False),
        ("price\nwithin", "x", False),
        ("nowhere", "x", False),
        ("pays", "owes", False),
        ("ten ", "20 <b> ", True),
        ("Heading", "a\x01", False),
        ("& m", "and m", False),
    ]
    out, statuses = revised_package(raw, asked)
    assert statuses == [APPLIED, SEVERAL, EMPTY, CROSSES, MISSING, CLASHES, APPLIED, UNSAID, APPLIED]
    assert blocks(out, False) == blocks(raw)
    assert blocks(out, True) == ["The seller gets a price", "within 20 <b> days, or 20 <b> weeks", "Heading and more"]
    xml = tracked._open(out).read("word/document.xml").decode()
    assert "<w:r><w:rPr><w:b/></w:rPr><w:delText" in xml and "<w:r><w:rPr><w:b/></w:rPr><w:t xml:space=\"preserve\">seller gets a</w:t>" in xml
    # what is tracked already stays as it is
    again, statuses = revised_package(out, [("seller", "x", False), ("within", "in", False)])
    assert statuses == [HELD, APPLIED] and blocks(again, True)[0] == "The seller gets a price"
    assert len(set(ids := re.findall(r'w:id="(\d+)"', tracked._open(again).read("word/document.xml").decode()))) == len(ids)


@pytest.mark.parametrize("prefix", ["q:", ""])
def test_other_prefixes_and_runs_of_many_elements(prefix):
    p = prefix
    ns = f'xmlns{":q" if p else ""}="{tracked.W[1:-1]}"'
    xml = f"<{p}document {ns}><{p}body><{p}p><{p}r><{p}rPr><{p}i/></{p}rPr><{p}t>one</{p}t><{p}tab/><{p}t>two &amp; three</{p}t></{p}r></{p}p></{p}body></{p}document>"
    raw = tracked.repacked(docx_package("x"), {"word/document.xml": xml.encode()})
    out, statuses = revised_package(raw, [("two & t", "2 & T", False), ("one\ttwo", "x", False), ("e\t", "x", False)])
    assert statuses == [APPLIED, CLASHES, HELD]
    assert blocks(out, True) == ["one\t2 & Three"] and blocks(out, False) == ["one\ttwo & three"]
    assert docx_text(out)[0] == "one\ttwo & t2 & Three"


def test_random_revisions():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab<& ") for _ in range(rng.randint(1, 40)))
        cut = sorted(rng.randint(0, len(text)) for _ in range(3))
        runs = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])]
        raw = package_of("<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{tracked.escape(r)}</w:t></w:r>' for r in runs) + "</w:p>")
        a = rng.randrange(len(text))
        old, new = text[a : a + rng.randint(1, 4)], rng.choice(["", "new", "a", " x "])
        out, (status,) = revised_package(raw, [(old, new, True)])
        assert status == APPLIED and blocks(out, True) == [text.replace(old, new)] and blocks(out, False) == [text]


def test_tables_of_packages(spark):
    shape = f"pair_id long, old {tracked.SHAPE}, new {tracked.SHAPE}, changes string"
    rows = [(1, [("a", None), (None, [["x", None]])], None, "c"), (2, None, None, "c"), (3, [("\x01", None)], [], "c"), (None, [], [("b", None)], "c")]
    out = tracked.tracked(spark.createDataFrame(rows, shape))
    assert {(r.pair_id, r.changes, r.error) for r in out.collect()} == {(1, 4, None), (2, 0, None), (3, None, "a character that XML cannot hold"), (None, 2, None)}
    read = {r.pair_id: r for r in tracked.versions(out, ["pair_id"]).collect()}
    assert read[1].accepted == [] and [b.text for b in read[1].rejected] == ["a", None] and read[1].rejected[1].rows == [["x", ""]]
    assert read[3].accepted is None and read[3].error
    revisions = spark.createDataFrame([(1, 2, "a", "b", None), (1, 1, None, "b", True)], "path long, position int, old string, new string, every boolean")
    done = {r.path: r for r in tracked.revised(out.select(out.pair_id.alias("path"), "content").where("content is not null"), revisions).collect()}
    assert [tuple(x) for x in done[1].results] == [(1, EMPTY), (2, HELD)] and done[2].results == []
    assert tracked.tracked(spark.createDataFrame([], shape)).count() == 0
