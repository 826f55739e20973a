"""Bookkeeping of matters: overviews, logs, names, dictionaries, encrypted vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION_DAYS = 30


def overview(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """(matter_id, documents, answers, latest) of all matters that have any."""
    d = documents.groupBy("matter_id").agg(F.count(F.lit(1)).alias("documents"), F.max("created").alias("latest"))
    a = answers.groupBy("matter_id").agg(F.count(F.lit(1)).alias("answers"))
    return d.join(a, "matter_id", "full").select("matter_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("answers", F.lit(0)).alias("answers"), "latest")


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The `most` newest rows by `created`, of equally new ones those with the larger id: a report of the last entries."""
    return rows.orderBy(F.desc("created"), F.desc("id")).limit(most)


def log_totals(log: DataFrame) -> DataFrame:
    """(tool, calls, hits, characters) of an outgoing log."""
    return log.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("hits").alias("hits"), F.sum("characters").alias("characters"))


def free_numbers(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (matter_id, created, id) with the matter's smallest free number from 1, in order of (created, id).

    A free number lies at most as far as there are rows, so numbers up to that are the candidates of each matter.
    """
    n = wanted.groupBy("matter_id").agg(F.count(F.lit(1)).alias("w")).join(taken.groupBy("matter_id").agg(F.count(F.lit(1)).alias("t")), "matter_id", "left")
    free = n.select("matter_id", F.explode(F.sequence(F.lit(1), (F.col("w") + F.coalesce("t", F.lit(0))).cast("int"))).alias("number")).join(taken.select("matter_id", "number"), ["matter_id", "number"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("matter_id").orderBy("number")))
    asked = wanted.withColumn("k", F.row_number().over(Window.partitionBy("matter_id").orderBy("created", "id")))
    return asked.join(free, ["matter_id", "k"]).drop("k")


def unique_names(names: DataFrame) -> DataFrame:
    """names (matter_id, created, id, name) with `unique_name`: (2), (3), ... after repeated ones, at most 80 characters."""
    k = F.row_number().over(Window.partitionBy("matter_id", F.substring("name", 1, 80)).orderBy("created", "id"))
    tail = F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise("")
    return names.withColumn("__tail", tail).withColumn("unique_name", F.concat(F.substring(F.col("name"), F.lit(1), 80 - F.length("__tail")), "__tail")).drop("__tail")


def set_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of new whose keys it does not have, each once."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def extra(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that left has more often than right, as often as it has them more."""
    return left.exceptAll(right)


def sealed(value: Column, key: Column) -> Column:
    """A vault column, encrypted (AES-GCM) under a 16, 24 or 32 byte key that comes from outside."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def opened(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def report(findings: DataFrame, suspects: DataFrame) -> DataFrame:
    """(doc_id, report): a Markdown report. Kept values appear as counts only; suspects with their text, to be judged."""
    counts = findings.groupBy("doc_id", "label_type").agg(F.count(F.lit(1)).alias("n"))
    table = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label_type"))).alias("c"))
    rows = F.array_join(F.transform("c", lambda x: F.concat(F.lit("| "), x["label_type"], F.lit(" | "), (-x["n"]).cast("string"), F.lit(" |"))), "\n")
    seen = suspects.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "label_type", "text"))).alias("s"))
    lines = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["label_type"], F.lit(": "), x["text"])), "\n")
    both = table.join(seen, "doc_id", "full")
    return both.select("doc_id", F.concat_ws("\n", F.lit("# Masking\n\n| Type | Findings |\n|---|---|"), rows, F.when(F.col("s").isNotNull(), F.concat(F.lit("\n## Suspects\n"), lines))).alias("report"))


def revise(texts: DataFrame, revisions: DataFrame) -> DataFrame:
    """(doc_id, old, new, status) of revisions (doc_id, old, new, all): applied, or why not: empty, line-break, not-found,
    ambiguous (more than one place, unless `all`)."""
    places = F.size(F.split("text", F.concat(F.lit("\\Q"), F.col("old"), F.lit("\\E")), -1)) - 1
    status = (
        F.when(F.coalesce(F.length("old"), F.lit(0)) == 0, "empty")
        .when(F.contains("old", F.lit("\n")) | F.contains("new", F.lit("\n")), "line-break")
        .when(F.col("text").isNull() | (places == 0), "not-found")
        .when((places > 1) & ~F.col("all"), "ambiguous")
        .otherwise("applied")
    )
    return revisions.join(texts.select("doc_id", "text"), "doc_id", "left").select("doc_id", "old", "new", status.alias("status"))
