from docveil.operators import staging, structure
from docveil.plans import contracts

CONTRACT = [
    ("", "Sale of goods"), ("", "Article 1 Scope"), ("", "This is the first paragraph, see Article 2.1(b) and Article 9."), ("", "(a) one clause"), ("", "(b) another, as in Clause 1(a), 2 and 7.4"),
    ("c1", "Text in a column, Art. 1 (c)"), ("c1", "Article 6 Price"), ("c2", "MADDE 6 Bedel"), ("c2", "(1) Peşin; 2. maddenin 1. fıkrasının (b) bendi, 2. maddenin 5. fıkrası"), ("c1", "(a) net"),
    ("", "Article 2 Delivery, which this heading tells at some length in its words"), ("", "2.1 By ship"), ("", "(b) or by air"), ("", "Next text under Section 2.1, Section 5 of the Sale Act, 6098 sayılı Kanun madde 27"),
    ("", "3. A bare number"), ("", "within Article 2 and 30 days"),
]


def rows(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, s, t) for i, (s, t) in enumerate(texts)], "doc_id long, p_idx int, stream string, text string")


def test_places_are_carried_on(spark):
    got = [(r.kind, r.article, r.part, r.clause, r.paragraph, r.place) for r in structure.placed(rows(spark, CONTRACT)).orderBy("p_idx").collect()]
    assert got == [
        ("text", None, None, None, 0, None), ("article", "1", "1", None, 0, "1"), ("text", "1", "1", None, 1, "1"), ("clause", "1", "1", "a", 1, "1(a)"), ("clause", "1", "1", "b", 1, "1(b)"),
        ("text", "1", "1", None, 1, "1"), ("article", "6", "6", None, 0, "6"), ("article", "6", "6", None, 0, "6"), ("paragraph", "6", "6", None, 0, "6"), ("clause", "6", "6", "a", 0, "6(a)"),
        ("article", "2", "2", None, 1, "2"), ("part", "2", "2.1", None, 1, "2.1"), ("clause", "2", "2.1", "b", 1, "2.1(b)"), ("text", "2", "2.1", "b", 2, "2.1"), ("order", "2", "2.1", "b", 2, "2.1"), ("text", "2", "2.1", "b", 3, "2.1"),
    ]


def test_references_and_what_is_missing(spark):
    df = rows(spark, CONTRACT)
    asked = sorted((r.p_idx, r.part, r.below, r.paragraph) for r in structure.references(df).collect())
    assert asked == sorted([
        (2, "2.1", "(b)", None), (2, "9", "", None), (4, "1", "(a)", None), (4, "2", "", None), (4, "7.4", "", None), (5, "1", "(c)", None), (8, "2", "(b)", "1"), (8, "2", "", "5"), (13, "2.1", "", None), (15, "2", "", None),
    ])
    missing = sorted((r.p_idx, r.part, r.below, r.paragraph, r.rule) for r in structure.dangling(df).collect())
    assert missing == [(2, "9", "", None, "article"), (4, "7.4", "", None, "article"), (5, "1", "(c)", None, "part"), (8, "2", "", "5", "part")]


def test_edge_rows(spark):
    assert structure.dangling(rows(spark, [])).count() == 0
    df = rows(spark, [("", None), ("", ""), ("c", "Article 4")])
    assert [r.place for r in structure.placed(df).orderBy("p_idx").collect()] == [None, None, "4"]
    assert structure.dangling(rows(spark, [("", "see Article 4")])).count() == 0


def test_tasks_follow_the_rows(spark, sf_dir):
    assert staging.tasks(spark.range(101), 50) == 3 and staging.tasks(spark.range(0)) == 1
    df = rows(spark, CONTRACT).unionByName(rows(spark, CONTRACT, 2))
    assert sorted(map(str, structure.dangling(df, 3).collect())) == sorted(map(str, structure.dangling(df).collect()))
    # dealt by key and number, which no later step puts together again
    assert "RepartitionByExpression [l_orderkey" in contracts.contract_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
