"""Order lines as rows of bilingual tables, written in Turkish and in English: what differs follows from the tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators import figures
from docveil.plans.contracts import PLACE
from docveil.plans.queries import table


def bilingual_cells(spark: SparkSession, sf_dir: str, sides: int = 2) -> DataFrame:
    """Every order's lines as a table of two columns, the right one with a fault by l_partkey % 11. Of every fifth order both columns
    are English; every seventh order lacks the right cells of its odd parts. sides: 1 for the left columns alone."""
    q, n, m = F.col("l_partkey") % 11, F.col("l_linenumber"), F.col("l_suppkey") % 9 + 1
    price, percent, day, pieces = F.col("l_extendedprice").cast("decimal(12,2)"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")
    off = lambda k: (q == k).cast("int")
    english = lambda n, price, percent, day, pieces, m: F.concat(
        F.lit("Article "), n, F.lit(". The price of USD "), F.format_number(price, 2), F.lit(" and the rate of "), percent, F.lit("% are due on "), F.date_format(day, "MMMM d, yyyy"), F.lit(" for "), pieces, F.lit(" of the pieces that are in Article "), m
    )
    turkish = F.concat(
        F.lit("Madde "), n, F.lit(". Bu bedel "), F.translate(F.format_number(price, 2), ",.", ".,"), F.lit(" dolar olarak ve %"), percent, F.lit(" oran ile "), F.date_format(day, "dd.MM.yyyy"), F.lit(" günü, bu "), pieces, F.lit(" adet için de Madde "), m, F.lit(" ile ödenir")
    )
    left = F.when(F.col("l_orderkey") % 5 == 0, english(n, price, percent, day, pieces, m)).otherwise(turkish)
    right = english(n + off(1), price + off(2), percent + off(3), F.date_add(day, off(4)), F.when(q == 6, "some").otherwise((pieces + off(5)).cast("string")), m + off(7))
    right = F.when((F.col("l_orderkey") % 7 != 0) | (F.col("l_partkey") % 2 == 0), right)
    cells = F.array(*[F.struct(F.lit(0).alias("col"), left.alias("text")), F.struct(F.lit(1).alias("col"), right.alias("text"))][:sides])
    # rows are numbered before their cells are rows of their own
    placed = table(spark, sf_dir, "lineitem").withColumn("row", F.expr(PLACE))
    return placed.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("table_id"), "row", F.lit(0).alias("p_idx"), F.inline(cells))


def bilingual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = figures.bilingual_findings(bilingual_cells(spark, sf_dir))
    return found.select("doc_id", "row", "kind", "severity", F.array_join("only_left", ",").alias("only_left"), F.array_join("only_right", ",").alias("only_right"))


def _shown(value: str) -> str:
    return f"regexp_replace(regexp_replace(({value})::VARCHAR, '0+$', ''), '[.]$', '') || ' USD'"


_PRICE = "l_extendedprice::DECIMAL(12, 2)"
_SIDES = {
    1: ("label", "l_linenumber::VARCHAR", "(l_linenumber + 1)::VARCHAR"), 2: ("amount", _shown(_PRICE), _shown(f"({_PRICE} + 1)")), 3: ("percent", "round(l_discount * 100)::INT::VARCHAR", "(round(l_discount * 100)::INT + 1)::VARCHAR"),
    4: ("date", "strftime(l_shipdate, '%Y-%m-%d')", "strftime(l_shipdate + INTERVAL 1 DAY, '%Y-%m-%d')"), 5: ("number", "l_quantity::INT::VARCHAR", "(l_quantity::INT + 1)::VARCHAR"),
    7: ("reference", "(l_suppkey % 9 + 1)::VARCHAR", "(l_suppkey % 9 + 2)::VARCHAR"),
}
_PAIR = "(l_orderkey % 7 <> 0 OR l_partkey % 2 = 0)"
BILINGUAL_SQL = f"""SELECT doc_id, row, kind, CASE kind WHEN 'number' THEN 'medium' ELSE 'high' END AS severity, l AS only_left, r AS only_right FROM
    (SELECT l_orderkey AS doc_id, {PLACE} AS row, {_PAIR} AS pair, count(*) FILTER (WHERE {_PAIR}) OVER (PARTITION BY l_orderkey) AS pairs, count(*) OVER (PARTITION BY l_orderkey) AS n,
        {', '.join(f"CASE l_partkey % 11 {' '.join(f'WHEN {k} THEN {chr(39) + v[i] + chr(39) if i == 0 else v[i]}' for k, v in _SIDES.items())} END AS {name}" for i, name in enumerate(('kind', 'l', 'r')))} FROM lineitem)
    WHERE kind IS NOT NULL AND pair AND doc_id % 5 <> 0 AND pairs >= 2 AND pairs >= 0.6 * n"""


def cell_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, amounts, percentages and numbers of the left cells, read in the language of their table."""
    cells = bilingual_cells(spark, sf_dir, sides=1)
    read = figures.read(cells, F.col("text"), F.when(F.col("doc_id") % 5 == 0, "en").otherwise("tr"), ["doc_id", "row"])
    return read.select("doc_id", "row", "kind", "value")


FIGURES_SQL = f"""SELECT doc_id, row, unnest(['date', 'amount', 'percent', 'number']) AS kind, unnest([d, a, p, n]) AS value FROM
    (SELECT l_orderkey AS doc_id, {PLACE} AS row, strftime(l_shipdate, '%Y-%m-%d') AS d, {_shown(_PRICE)} AS a, round(l_discount * 100)::INT::VARCHAR AS p, l_quantity::INT::VARCHAR AS n FROM lineitem)"""

QUERIES = {"bilingual_findings": (bilingual_findings, BILINGUAL_SQL), "cell_figures": (cell_figures, FIGURES_SQL)}
