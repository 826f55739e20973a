import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docveil.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"
HARD = [
    chat.PLANTED, "", "\\", "a\\", "<", "</turn", "</turn>", "<\\/turn>", "<\\\\/turn>\\", "#", "### User: ### User: ", "#### User: x", "#\\## Role 41: </turn>\n### User: b",
    "\n", "###", "### Role ", "é\U0001f600</turn>", "$1 \\1", "x" * 300000 + "</turn>" * 2000,
]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_template_must_be_readable():
    for bad in ({"end": "<\\x>"}, {"end": "# ### User"}, {"end": "aa"}, {"end": "<\nx>"}, {"end": "x"}, {"other": "### User: b"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    assert chat.Template(end="<end>").end == "<end>"


def test_hard_texts_come_back(spark):
    roles = ["system", "user", "assistant", "tool", "critic: é", None]
    rows = [(k, i, roles[(i + k) % 6], t, "x", 1) for k in range(6) for i, t in enumerate([*HARD, None])]
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA)).select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt(F.col("segments")).alias("learnt")).collect()
    assert len(out) == 6
    for r in out:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.learnt == "".join(t for role, t in want if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count("</turn>") == len(want)
        assert not r.valid and not r.complete and r.error_turn is not None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn> \nUser:Assistant", max_size=40), min_size=1, max_size=20))
def test_any_text_comes_back(spark, texts):
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat.formatted(df).select(chat.turns_of(F.col("formatted")).alias("turns")).first()
    assert [t.text for t in r.turns] == texts


def test_order_of_turns(spark):
    cases = {"ua": (True, True, None), "sua": (True, True, None), "u": (True, False, None), "s": (True, False, None), "a": (False, False, 0), "uu": (False, False, 1), "ss": (False, False, 1),
             "suaa": (False, False, 3), "uatau": (True, False, None), "uas": (False, False, 2), "uta": (False, False, 1)}
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(k, i, names[c], f"{i}") for k, case in enumerate(cases) for i, c in enumerate(case)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: (r.valid, r.complete, r.error_turn) for r in chat.formatted(df).collect()}
    assert out == {k: v for k, v in enumerate(cases.values())}
    learns = chat.Template(learn_end=True)
    segments = chat.formatted(df.where("conv_id = 0"), learns).first().segments
    assert [s.text for s in segments if s.loss] == ["1", "</turn>"]


def test_edge_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, None, "user", "first"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, "f", 0) for r in rows], SCHEMA)
    out = {r.conv_id: r for r in chat.formatted(df).select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    assert [t.text for t in out[1].turns] == ["first", "same", "same"] and [t.text for t in out[None].turns] == ["a", "b"]
    assert [tuple(t) for t in out[2].turns] == [("", "")]
    assert chat.formatted(df.limit(0)).count() == 0


def test_query_against_sql_and_recount(spark, tmp_path):
    rows = [(i % 40, (i * 7) % 11, ["user", "assistant", "system", "tool", "judge", None][i % 6 if i % 5 else i % 2], HARD[i % len(HARD)] if i % 3 else None) for i in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/odd/conversations.parquet")
    for sf_dir, glob in ((f"{tmp_path}/odd", "/*.parquet"), ("/root/testdata/sf0.01", "")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS FROM '{sf_dir}/conversations.parquet{glob}'")
        want, got = con.sql(chat.SQL), chat.op13(spark, sf_dir)
        assert want.columns == got.columns
        got = sorted(map(tuple, got.collect()), key=str)
        assert got == sorted(want.fetchall(), key=str)
        planted = next(r for r in got if r[0] == -7)
        both = f"user\n{chat.PLANTED}\nassistant\n{chat.PLANTED}\n"
        assert planted[1:5] == (2, digest(both), len(chat.PLANTED), digest(chat.PLANTED))


def test_native(spark, sf_dir):
    plan = chat.op13(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
