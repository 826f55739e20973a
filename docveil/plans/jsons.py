"""JSON made of events and documents, masked in every string at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import jsons
from docveil.plans.queries import documents, table

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"
#: An event with its properties, addresses as a value and as a key, and what is no string. Both engines read this SQL.
REPLY = """'{"props": ' || props || ', "who":["user' || user_id || '@shop.example", null, true, 1.50, ""], "user' || user_id || '@shop.example" : {"' || event_type || '":"k"}}'"""


def masked(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "{{EPOSTA}}")


def json_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "events").selectExpr("event_id", f"{REPLY} AS reply")
    return replies.select("event_id", jsons.mapped(F.col("reply"), masked).alias("masked"), jsons.mapped(F.col("reply"), masked, keys=False).alias("values_masked"))


JSON_SQL = f"""SELECT event_id, replace(reply, 'user' || user_id || '@shop.example', '{{{{EPOSTA}}}}') AS masked, replace(reply, '["user' || user_id || '@shop.example', '["{{{{EPOSTA}}}}') AS values_masked
    FROM (SELECT event_id, user_id, {REPLY} AS reply FROM events)"""


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as JSON, masked, and read again."""
    reply = F.to_json(F.struct(F.struct(F.split("text", "\n").alias("lines")).alias("content"), F.col("source").alias("source")))
    rows = documents(spark, sf_dir).select("doc_id", jsons.mapped(reply, masked).alias("reply"))
    read = F.from_json("reply", "content struct<lines: array<string>>, source string")
    return rows.select("doc_id", read["source"].alias("source"), F.sha2(F.array_join(read["content"]["lines"], "\n"), 256).alias("masked_sha256"))


TEXTS_SQL = f"SELECT doc_id, source, sha256(regexp_replace(text, '{EMAIL}', '{{{{EPOSTA}}}}', 'g')) AS masked_sha256 FROM documents"

QUERIES = {"json_masked": (json_masked, JSON_SQL), "json_texts": (json_texts, TEXTS_SQL)}
