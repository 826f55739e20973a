import random
import re
import zipfile
from collections import Counter
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from docveil.operators import diff
from docveil.plans import packages
from docveil.sources import files, tracked

WORDS = ["the", "buyer", "Ab", "İstanbul", "{{X 1}}", "{{", "_", "..", "a.b", "o'clock", "5,000", "\x1f", " ", "\n", " ", " ", "ſ", "日本", "😀"]


def test_plain_packages_are_read_as_they_stand(monkeypatch):
    raw, _ = tracked.tracked_package([[["a", " b "], ["c", "d"]]], [[["a", " b "], ["c", "e & <f>"], ["g"]]])
    wanted = tracked.readings(raw, (True, False))
    assert wanted == [[[["a", " b "], ["c", "e & <f>"], ["g"]]], [[["a", " b "], ["c", "d"]]]]

    def opened(_):
        raise AssertionError("opened as any archive")

    monkeypatch.setattr(tracked, "_open", opened)
    assert tracked.readings(raw, (True, False)) == wanted


def test_other_archives_are_opened():
    raw, _ = tracked.tracked_package(["one"], ["two"])
    again = BytesIO()
    with zipfile.ZipFile(BytesIO(raw)) as old, zipfile.ZipFile(again, "w") as new:
        new.comment = b"a comment"
        for n in old.namelist():
            new.writestr(n, old.read(n))
    assert tracked.readings(again.getvalue(), (True, False)) == [["two"], ["one"]]
    for bad in (b"", b"PK", raw[:-9]):
        with pytest.raises(files.Unreadable):
            tracked.readings(bad, (True,))
    empty = BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(files.Unreadable, match="not XML"):
        tracked.readings(empty.getvalue(), (True,))


def test_cells_of_any_kind():
    gone = "<w:p><w:pPr><w:rPr><w:del/></w:rPr></w:pPr><w:r><w:t>x</w:t></w:r></w:p>"
    cells = ["<w:p><w:r><w:t>one</w:t></w:r></w:p>", "<w:p/>", gone, f"{gone}<w:p><w:r><w:t>y</w:t></w:r></w:p>", "<w:p><w:r><w:t>a</w:t><w:tab/><w:t/></w:r></w:p>", "<w:p><w:del><w:r><w:delText>d</w:delText></w:r></w:del></w:p>", "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"]
    row = f"<w:tbl><w:tr>{''.join(f'<w:tc>{c}</w:tc>' for c in cells)}</w:tr></w:tbl>"
    assert tracked.readings(files.package_of(row), (None, True)) == [[[["one", "", "x", "x\ny", "a\t", "d", "in"]]], [[["one", "", "x", "xy", "a\t", "", "in"]]]]


def test_words_and_pairs():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 6)))
    for _ in range(500):
        a, b = text(), text()
        bags = [Counter(u.lower() for u in diff.units(x) if not u.isspace()) for x in (a, b)]
        assert [diff.bag(a), diff.bag(b)] == bags
        total = bags[0].total() + bags[1].total()
        likeness = 2 * (bags[0] & bags[1]).total() / total if total else 1.0
        assert diff.paired([a], [b], 0.45) == ([(0, 0)] if likeness >= 0.45 else [])


def test_orders_are_dealt_before_their_texts_are_made(spark, sf_dir):
    """By number of lines, and as keys alone: the exchange has no text, and tasks follow the lines."""
    df = packages.order_tables(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.search(rf"RepartitionByExpression \[l_orderkey#\d+L?\], {-(-lines // 25_000)}\n(.*)", plan, re.S)
    assert dealt and "concat" in plan and "concat" not in dealt[1]
    assert df.select(F.sum(F.size("old"))).first()[0] == lines
