import re

from pyspark.sql import functions as F

from docveil.operators import figures
from docveil.plans import bilingual

TEXTS = [
    ("en", "Article 5 The price of USD 1,250.50 and 2,000 EUR is due on May 5th, 2024, at 12.5% or 3 percent, for 1,500 units, see Article 7."),
    ("tr", "5. Bedel 1.250,50 TL, 300 Türk Lirası ve 20 dolardır; 12 Mart 2024 ve 01.02.2023 tarihinde %12,5 ve yüzde 3 ile 1.500 adet, 7. maddenin 2. fıkrası"),
    ("tr", "  5. maddenin 2. fıkrası ve 3 gün"),
    ("az", "2. maddə 10 manat və 3 yanvar 2024, Sentyabr 9, 2021"),
    ("en", "TL 5 May 2024, 3yüzde 5, 2/5% and 13/25/2024, 0999-01-01"),
    ("en", "7 3 d4 8"),
    ("en", "us$5 $ 7 5€ xusd 4 1 234,5"),
    ("en", "none"),
    ("en", None),
]
WANTED = {
    2: ["number 3"], 3: ["date 2021-09-09", "date 2024-01-03"], 4: ["date 0999-01-01", "date 2024-05-05", "number 2", "number 3", "percent 5", "percent 5"],
    5: ["number 3", "number 7", "number 8"], 6: ["amount 5 EUR", "amount 5 USD", "amount 7 USD", "number 1234.5", "number 4"], 7: [], 8: [],
}


def frame(spark):
    return spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate(TEXTS)], "i int, l string, t string")


def test_figures_as_rows(spark):
    df = frame(spark)
    rows = figures.read(df, F.col("t"), F.col("l"), ["i"])
    assert rows.columns == ["i", "kind", "value"]
    got = {i: sorted(f"{r.kind} {r.value}" for r in rows.where(F.col("i") == i).collect()) for i in range(len(TEXTS))}
    same = {r.i: sorted(f"{x.kind} {x.value}" for x in r.f or []) for r in df.select("i", figures.figures(F.col("t"), F.col("l")).alias("f")).collect()}
    assert got == same
    assert {i: got[i] for i in WANTED} == WANTED


def test_places_count_no_marks(spark):
    for r in frame(spark).select("t", figures.figures(F.col("t"), F.col("l")).alias("f")).where("t is not null").collect():
        for x in r.f:
            assert re.search("[0-9]", r.t[x.start : x.end]) and x.end <= len(r.t)
        assert all(r.t[x.start : x.end].strip() == r.t[x.start : x.end] for x in r.f)


def test_reading_is_compiled(spark):
    """No function of arrays, which is interpreted for every text, and no method beyond the 8,000 bytes that the JVM compiles."""
    rows = figures.read(frame(spark), F.col("t"), F.col("l"), ["i"])
    execution = rows._jdf.queryExecution()
    assert not re.search(r"\b(transform|filter|aggregate|lambdafunction)\(", execution.optimizedPlan().toString())
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", execution.explainString(mode))]
    assert sizes and max(sizes) < 8000


def test_texts_of_tables_are_put_together_once(spark, monkeypatch):
    plans, keep = {}, figures.kept

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(figures, "kept", seen)
    rows = [(1, 0, r, c, 0, t) for r, pair in enumerate([("Madde 1. Bu bedel 5 ve 6 ile", "Article 1. The price of 5 is for 6")] * 2) for c, t in enumerate(pair)]
    figures.bilingual_findings(spark.createDataFrame(rows, "doc_id long, table_id int, row int, col int, p_idx int, text string")).collect()
    assert sum(p.count("collect_list") for p in plans.values()) == 1


def test_cell_figures_reads_rows(spark, sf_dir):
    """The query's own plan: figures come as rows, and nothing of a text goes through functions of arrays."""
    execution = bilingual.cell_figures(spark, sf_dir)._jdf.queryExecution()
    assert not re.search(r"\b(transform|filter|aggregate|lambdafunction)\(", execution.optimizedPlan().toString())
