"""What users and their assistants ask of a matter's documents, one DataFrame an answer: list, read, revise, deliver, and the
review of suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.operators import matters, pages, vault
from docveil.operators.match import splice


def listing(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, matter_id, characters, labels, types): masked documents (doc_id, matter_id, masked) with how many different
    labels of labels (matter_id, label, label_type) each has, in all and by type. No value of a vault is shown."""
    known = labels.select("matter_id", vault.folded(F.col("label")).alias("folded"), "label_type")
    met = vault.labels_in(masked.select("doc_id", "matter_id", F.col("masked").alias("text"))).join(known, ["matter_id", "folded"])
    by_type = met.groupBy("doc_id", "label_type").agg(F.count_distinct("folded").alias("n"))
    counts = by_type.groupBy("doc_id").agg(F.sum("n").alias("labels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label_type", "n")))).alias("types"))
    rows = masked.select("doc_id", "matter_id", F.coalesce(F.length("masked"), F.lit(0)).alias("characters")).join(counts, "doc_id", "left")
    return rows.withColumn("labels", F.coalesce("labels", F.lit(0)))


def part_of(masked: DataFrame, part: int = 1, size: int = pages.PART) -> DataFrame:
    """(doc_id, part, parts, text): one part of each masked document that has so many; labels are not cut."""
    rows = masked.select("doc_id", F.coalesce("masked", F.lit("")).alias("text"))
    cut = pages.parts(rows.withColumn("__labels", vault.spans(F.col("text"), vault.LABEL)), size, protected="__labels")
    count = cut.groupBy("doc_id").agg(F.max("part").alias("parts"))
    chosen = cut.where(F.col("part") == part).join(count, "doc_id")
    return chosen.join(rows, "doc_id").select("doc_id", "part", "parts", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def revised(texts: DataFrame, revisions: DataFrame) -> DataFrame:
    """(doc_id, revised, applied, refused): texts (doc_id, text) with those revisions (doc_id, old, new, all) applied that
    `matters.revise` admits and that share no place with another one; revisions that overlap are all refused. A document's
    revisions are one array."""
    judged = matters.revise(texts, revisions).withColumn("ok", F.col("status") == "applied")
    wanted = judged.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("ok"), F.struct("old", "new")))).alias("__wanted"), F.count(F.lit(1)).alias("__asked"))
    rows = texts.select("doc_id", "text").join(wanted, "doc_id", "left")
    literal = lambda w: F.concat(F.lit("\\Q"), F.replace(w["old"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    at = lambda w: F.transform(vault.spans(F.col("text"), literal(w)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), w["new"].alias("replacement")))
    rows = rows.withColumn("__places", F.transform("__wanted", lambda w: F.struct(w.alias("w"), at(w).alias("edits"))))
    clash = lambda p, q: (p["w"] != q["w"]) & F.exists(p["edits"], lambda a: F.exists(q["edits"], lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    rows = rows.withColumn("__free", F.filter("__places", lambda p: ~F.exists(F.col("__places"), lambda q: clash(p, q))))
    done = F.coalesce(F.size("__free"), F.lit(0))
    text = F.when(done > 0, splice(F.col("text"), F.flatten(F.transform("__free", lambda p: p["edits"])))).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("revised"), F.when(F.col("__free").isNull(), 0).otherwise(done).alias("applied"), (F.coalesce("__asked", F.lit(0)) - F.when(F.col("__free").isNull(), 0).otherwise(done)).cast("int").alias("refused"))


def delivered(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, unmasked, resolved, unknown): answers (doc_id, matter_id, text) with labels put back, how many there were, and
    the sorted labels that no vault has."""
    return vault.read_back(answers, labels).select("doc_id", "unmasked", "resolved", "unknown")


def approved(kept: Column, suspects: Column, chosen: Column) -> Column:
    """kept and those suspects that a reviewer chose by their (start, end), at full score, where they overlap nothing kept."""
    picked = F.filter(suspects, lambda s: F.exists(chosen, lambda c: (c["start"] == s["start"]) & (c["end"] == s["end"])))
    free = F.filter(picked, lambda s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])))
    return F.array_sort(F.concat(kept, F.transform(free, lambda s: s.withField("score", F.lit(100)))))
