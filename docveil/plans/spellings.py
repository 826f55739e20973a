"""Known values planted in texts by key arithmetic, for the gate: which text shows which value follows from the keys alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators import gate
from docveil.operators.staging import shared_dir
from docveil.plans.queries import table
from docveil.streaming import outgoing

#: By c % 6, of a customer c: (type, value, value without separators, value with others). Every fourth order shows a value with
#: one more digit, which is another value. The SQL is Spark's.
FAMILIES = [
    ("PLAKA", "concat('34 ABC ', k)", "concat('34abc', k)", "concat('34–ABC–', k)"),
    ("TELEFON", "concat('0532', n)", "concat('90532', n)", "concat('+90 (532) ', left(n, 3), '-', substr(n, 4))"),
    ("IBAN", "concat('TR33 0006 1005 1978 ', n)", "concat('33000610051978', n)", "concat('IBANTR33-0006–1005-1978 ', n)"),
    ("TCKN", "concat('1957', n)", "concat('TC1957', n)", "concat('195 7 ', left(n, 3), '.', substr(n, 4))"),
    ("DOSYA_NO", "concat('2024/', 10000 + c, ' E.')", "concat('Esas 2024/', 10000 + c)", "concat('2024 - ', 10000 + c, ' Esas')"),
    ("ADRES", "concat('Lale Sok. No:', k)", "concat('LALE SOK No', k)", "concat('Lale Sok., No: ', k)"),
]


def _chosen(column: int) -> str:
    return "CASE c % 6 " + " ".join(f"WHEN {i} THEN {f[column]}" for i, f in enumerate(FAMILIES)) + " END"


_KNOWN = ["c div 5400 AS matter_id", "c", "100 + c div 6 % 900 AS k", "lpad(cast(c as string), 7, '0') AS n"]


def planted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of each customer; a matter has 5,400 customers."""
    kind = "CASE c % 6 " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(FAMILIES)) + " END"
    values = table(spark, sf_dir, "customer").selectExpr("c_custkey AS c").selectExpr(*_KNOWN)
    return values.selectExpr("matter_id", f"{kind} AS label_type", f"concat('{{{{', {kind}, '-', c, '}}}}') AS label", f"{_chosen(1)} AS value")


def planted_texts(orders: DataFrame) -> DataFrame:
    """A text of each order, in one of four spellings."""
    rows = orders.selectExpr("o_custkey AS c", "o_orderkey AS o").selectExpr("o", *_KNOWN)
    more = "CASE WHEN c % 6 = 4 THEN concat('2024/', 10000 + c, '9 E.') ELSE concat(" + _chosen(1) + ", '9') END"
    return rows.selectExpr("o AS out_id", "matter_id", f"concat('Order ', o, ': ', CASE o % 4 WHEN 0 THEN {_chosen(1)} WHEN 1 THEN {_chosen(2)} WHEN 2 THEN {_chosen(3)} ELSE {more} END, '; end.') AS text")


def gate_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' values, looked for in the texts of orders."""
    return gate.gate(planted_texts(table(spark, sf_dir, "orders")), planted_values(spark, sf_dir)).select("out_id", "label_type", "label", "hits")


PLANTED_SQL = f"""SELECT o_orderkey AS out_id, label_type, '{{{{' || label_type || '-' || o_custkey || '}}}}' AS label, 1::BIGINT AS hits
    FROM (SELECT *, {[f[0] for f in FAMILIES]}[o_custkey % 6 + 1] AS label_type FROM orders) WHERE o_orderkey % 4 <> 3"""


def gate_planted_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_planted(spark, sf_dir).groupBy("label_type").agg(F.sum("hits").alias("hits"), F.count_distinct("out_id").alias("texts"))


def gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of orders as a stream through the gate, whose log is read when all have passed."""
    base = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    vault, log = f"{base}/vault", f"{base}/log"
    outgoing.publish(planted_values(spark, sf_dir), vault)
    # as a pattern, the path may be one file as well as a folder
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")
    texts = planted_texts(orders).withColumn("tool", F.lit("list"))
    outgoing.guarded(texts, vault, log, f"{base}/checkpoint").awaitTermination()
    return outgoing.entries(spark, log, outgoing.LOG.format(out_id="bigint", matter_id="bigint")).select("out_id", "vault_version", "hits", F.regexp_replace("cleaned", "[^{}]*([{]{2}[^{}]*[}]{2})[^{}]*", "$1").alias("label"))


STREAM_SQL = f"""SELECT o_orderkey AS out_id, 1 AS vault_version, (o_orderkey % 4 <> 3)::BIGINT AS hits,
    CASE WHEN o_orderkey % 4 <> 3 THEN '{{{{' || {[f[0] for f in FAMILIES]}[o_custkey % 6 + 1] || '-' || o_custkey || '}}}}' END AS label FROM orders"""

QUERIES = {
    "gate_stream": (gate_stream, STREAM_SQL),
    "gate_planted": (gate_planted, PLANTED_SQL),
    "gate_planted_by_type": (gate_planted_by_type, f"SELECT label_type, sum(hits)::BIGINT AS hits, count(DISTINCT out_id) AS texts FROM ({PLANTED_SQL}) GROUP BY ALL"),
}
