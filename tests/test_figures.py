from pyspark.sql import functions as F

from docveil.operators import audit, figures, reports

TEXTS = [
    ("en", "Article 5 The price of USD 1,250.50 and 2,000 EUR is due on May 5th, 2024, at 12.5% or 3 percent, for 1,500 units, see Article 7.", "date:2024-05-05 amount:1250.5 USD amount:2000 EUR percent:12.5 percent:3 number:1500"),
    ("tr", "5. Bedel 1.250,50 TL, 300 Türk Lirası ve 20 dolardır; 12 Mart 2024 ve 01.02.2023 tarihinde %12,5 ve yüzde 3 ile 1.500 adet, 7. maddenin 2. fıkrası", "date:2024-03-12 date:2023-02-01 amount:1250.5 TRY amount:300 TRY amount:20 USD percent:12.5 percent:3 number:1500"),
    ("az", "10 manat və 3 yanvar 2024, Sentyabr 9, 2021", "date:2024-01-03 date:2021-09-09 amount:10 AZN"),
    ("en", "no 1.2.3 nor 12/2024 nor {{TUTAR-01}} nor a7 nor 7a; 12,345.678 and 0.125", "number:12345.678 number:0.125"),
    ("tr", "0,125 ve 1.234", "number:0.125 number:1234"),
    ("en", "TL 5 May 2024", "date:2024-05-05"),
    ("en", "31 February 2024 and 13/25/2024", ""),
    ("en", "", ""),
]


def test_figures_in_turn(spark):
    df = spark.createDataFrame([(i, l, t) for i, (l, t, _) in enumerate(TEXTS)] + [(99, "en", None)], "i int, l string, t string")
    got = df.select("i", "t", figures.figures(F.col("t"), F.col("l")).alias("f")).orderBy("i").collect()
    assert [" ".join(f"{x.kind}:{x.value}" for x in r.f) for r in got[:-1]] == [w for *_, w in TEXTS]
    assert got[-1].f is None
    places = sorted((x.start, x.end) for x in got[0].f)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:])) and TEXTS[0][1][places[0][0] : places[0][1]] == "USD 1,250.50"


def test_short_months_and_languages(spark):
    texts = ["5 Sept. 2024", "APRIL 7, 2020", "7 Oca 2020", "1 iyu 2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(audit.date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in df.collect()] == ["2024-09-05", "2020-04-07", "2020-01-07", None]
    texts = ["bu bir və bu ilə olan iş", "bu bir ve bu ile olan iş", "this is the law of the land", "x y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(audit.language(F.col("t"), figures.LANGUAGES).alias("d"))
    assert [r.d for r in df.collect()] == ["az", "tr", "en", None]


def cells(spark, tables):
    rows = [(1, t, r, c, 0, text) for t, table in enumerate(tables) for r, row in enumerate(table) for c, text in enumerate(row)]
    return spark.createDataFrame(rows, "doc_id long, table_id int, row int, col int, p_idx int, text string")


TR = ["Madde 1. Bu bedel 10,50 TL olarak ve 5 Mayıs 2024 ile ödenir", "Madde 2. Bu oran %5 ve Madde 1 ile olan süre 30 gün", "Madde 3. Bu da bir sayı 7 ve 7 için"]
EN = ["Article 1. The price of TRY 10.50 is due on May 5, 2024", "Article 2. The rate of 5% and the term in Article 1 is for 30 days", "Article 3. This is for the number 7 and for 7"]


def test_bilingual_tables(spark):
    same = [list(x) for x in zip(TR, EN)]
    faults = [
        [TR[0], EN[0].replace("10.50", "11.50").replace("May", "June")],
        [TR[1], EN[1].replace("Article 2", "Article 4").replace("in Article 1", "in Article 9").replace("5%", "6%").replace("30", "31")],
        [TR[2], EN[2].replace("for 7", "for seven")],
    ]
    found = figures.bilingual_findings(cells(spark, [same, faults, [[x, x] for x in EN], [["", same[0][0]], *same[:1], ["", ""]]]))
    got = sorted((r.table_id, r.row, r.kind, r.severity, " ".join(r.only_left), " ".join(r.only_right)) for r in found.collect())
    assert got == [
        (1, 0, "amount", "high", "10.5 TRY", "11.5 TRY"), (1, 0, "date", "high", "2024-05-05", "2024-06-05"), (1, 1, "label", "high", "2", "4"), (1, 1, "number", "medium", "30", "31"),
        (1, 1, "percent", "high", "5", "6"), (1, 1, "reference", "high", "1", "9"),
    ]


def test_bilingual_edges(spark):
    assert figures.bilingual_findings(cells(spark, [])).count() == 0
    df = cells(spark, [[[None, "x"], ["", None]], [[TR[0], EN[0], EN[1]], [TR[1], EN[1], ""]]])
    assert figures.bilingual_findings(df).count() == 0


def test_bilingual_rows_in_the_audit(spark):
    table = [[TR[0], EN[0]], [TR[1], EN[1].replace("5%", "6%")]]
    docs = spark.createDataFrame([(1, "nothing of note"), (2, "1. One\nsee Section 4")], "doc_id long, text string")
    found = reports.audit_findings(docs, cells(spark, [table])).collect()
    assert sorted((r.doc_id, r.no, r.rule, r.severity, r.p_idx, r.value) for r in found) == [(1, 1, "bilingual_percent", "high", None, "table 0, row 1: 5 | 6"), (2, 1, "missing_reference", "high", 1, "4")]
