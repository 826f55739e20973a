"""A corpus pipeline over `documents`: each stage calls one operator of docveil.llm on all that the stage before kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm import langid, packing, paritysketch, suffixdedup
from docveil.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without a letter, and those about as near to two languages, go."""
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs.select(F.struct("*").alias("row"), "text"), model, keys=("row",))
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (none is the smallest). Rows with the same doc_id and
    the same text are one document; with other texts, they are others."""
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    groups = paritysketch.join(rows, key="key")
    stay = groups.where(F.col("key") == F.col("component_id")).select(F.col("key").alias("stay")).distinct()
    return rows.join(stay, F.col("key").eqNullSafe(F.col("stay")), "left_semi").dropDuplicates(["key"]).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that have been before; those of which nothing is left go. Rows that share a doc_id but not
    the text are documents of their own."""
    others = F.struct(*(F.col(c) for c in docs.columns if c not in ("text", "n_chars")))
    kept = suffixdedup.dedup(docs.select(others.alias("row"), "doc_id", "text"), characters=True, carry="row")
    rest = kept.select("row.*", F.col("kept").cast("string").alias("text")).where("text <> ''")
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.packed_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("sequences", sequences),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
