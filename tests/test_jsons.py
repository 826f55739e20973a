import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docveil.functions import jsons


def walked(x, keys):
    if isinstance(x, str):
        return x.upper() + "!"
    if isinstance(x, dict):
        return {walked(k, keys) if keys else k: walked(v, keys) for k, v in x.items()}
    return [walked(v, keys) for v in x] if isinstance(x, list) else x


texts = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=6) | st.sampled_from(['"', '\\"', "a: {", "\\", "}],", "\n\t", "/", "é "])
anything = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | texts, lambda x: st.lists(x, max_size=4) | st.dictionaries(texts, x, max_size=4), max_leaves=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large, HealthCheck.large_base_example])
@given(st.lists(anything, min_size=30, max_size=60), st.booleans())
def test_any_value(spark, values, ascii):
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=ascii, indent=i % 2 or None)) for i, v in enumerate(values)], "i int, j string")
    change = lambda x: F.concat(F.upper(x), F.lit("!"))
    pairs = lambda x: [(k, pairs_of(v)) for k, v in x]

    def pairs_of(v):
        return pairs(v.items()) if isinstance(v, dict) else [pairs_of(x) for x in v] if isinstance(v, list) else v

    for r in df.select("i", jsons.mapped(F.col("j"), change).alias("all"), jsons.mapped(F.col("j"), change, keys=False).alias("values")).collect():
        v = values[r.i]
        assert json.loads(r["values"]) == walked(v, False)
        assert json.loads(r["all"]) == walked(v, True)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, '{"a": '), (4, " [ 1.50 , 1e3 ] "), (5, '"x"'), (6, '{"a" :"b"}'), (7, "{}"), (8, '["' + "y" * 500000 + '"]'), (9, '{"a": ["\\u0041\\n"]}')]
    df = spark.createDataFrame(rows, "i int, j string")
    out = {r.i: r for r in df.select("i", jsons.mapped(F.col("j"), lambda x: F.concat(x, F.lit("!"))).alias("m"), jsons.strings_of(F.col("j")).alias("s")).collect()}
    assert [out[i].m for i in range(1, 8)] == [None, None, None, " [ 1.50 , 1e3 ] ", '"x!"', '{"a!" :"b!"}', "{}"]
    assert len(out[8].m) == 500005 and out[9].s == ["a", "A\n"] and json.loads(out[9].m) == {"a!": ["A\n!"]}
