"""A stream of outgoing texts through the egress gate, against versions of the vault, with a log that has each text once.

A version of the vault is a folder of its own that is never written again, so a batch sees one state of the vault, and what is
compiled from it (the forms of its values) is written once a version. A batch's part of the log is a folder of its own too, and
a ledger names the batches that are whole: a batch that runs again after a failure takes its own folder's place, or, if the
ledger has it, does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docveil.operators import gate

FORMS = "matter_id {matter_id}, form string, label_type string, label string"
#: A text's entry: how long it was, how many values it showed, and, if any, the text with labels instead.
LOG = "out_id {out_id}, matter_id {matter_id}, tool string, vault_version int, characters bigint, hits bigint, cleaned string, batch_id bigint"
_VERSIONS, _BATCHES = "version int", "batch_id bigint"


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger at a path, which is made if there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _enter(spark: SparkSession, path: str, schema: str, number: int) -> None:
    """Twice the same entry is one."""
    spark.createDataFrame([(number,)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/n={number}")


def latest(spark: SparkSession, vault: str) -> int:
    """The newest whole version of a vault; 0 if it has none."""
    return _ledger(spark, f"{vault}/versions", _VERSIONS).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def publish(values: DataFrame, vault: str) -> int:
    """Writes all values (matter_id, label_type, label, value) of a vault as its next version, and gives its number. One
    publisher at a time; what one left unfinished is written over."""
    spark = values.sparkSession
    version = latest(spark, vault) + 1
    gate.value_forms(values).write.mode("overwrite").parquet(f"{vault}/forms/{version}")
    _enter(spark, f"{vault}/versions", _VERSIONS, version)
    return version


def logged(texts: DataFrame, forms: DataFrame, version: int) -> DataFrame:
    """(out_id, matter_id, tool, vault_version, characters, hits, cleaned) of every row of texts (out_id, matter_id, tool, text).
    Texts that are repeated are scanned once; repeated rows each have an entry. A null text has no characters and no hits; a null
    matter has no values."""
    digest = F.sha2("text", 256)
    rows = texts.select("out_id", "matter_id", "tool", "text", digest.alias("digest"))
    key = F.struct("matter_id", "digest")
    once = rows.where("matter_id is not null and text is not null").dropDuplicates(["matter_id", "digest"]).select(key.alias("out_id"), "matter_id", "text")
    found = gate.gate_by_forms(once, forms).groupBy("out_id").agg(F.sum("hits").alias("hits"), F.max("cleaned").alias("cleaned"))
    found = found.select(F.col("out_id.matter_id").alias("matter_id"), F.col("out_id.digest").alias("digest"), "hits", "cleaned")
    length = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    return rows.join(found, ["matter_id", "digest"], "left").select(
        "out_id", "matter_id", "tool", F.lit(version).alias("vault_version"), length.alias("characters"), F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"), "cleaned"
    )


def guarded(texts: DataFrame, vault: str, log: str, checkpoint: str) -> StreamingQuery:
    """Sends a stream of texts (out_id, matter_id, tool, text) through the gate into the log, until what there is now has passed.
    Each batch takes the newest version of the vault; with none, no text may pass, and the stream fails."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if not _ledger(spark, f"{log}/batches", _BATCHES).where(F.col("batch_id") == number).isEmpty():
            return
        version = latest(spark, vault)
        if not version:
            raise ValueError("the vault has no version yet")
        schema = FORMS.format(matter_id=rows.schema["matter_id"].dataType.simpleString())
        forms = spark.read.schema(schema).parquet(f"{vault}/forms/{version}")
        logged(rows, forms, version).withColumn("batch_id", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{log}/entries/{number}")
        _enter(spark, f"{log}/batches", _BATCHES, number)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, log: str, schema: str | StructType) -> DataFrame:
    """The log's entries of whole batches. The ledger is a number a batch, and is sent to all tasks only as Spark sees fit."""
    whole = _ledger(spark, f"{log}/batches", _BATCHES).distinct()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{log}/entries").join(whole, "batch_id", "left_semi")
