"""Which label a value gets when it is not in the vault letter by letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions.textfold import ascii_fold, ascii_lower


def known_labels(values: DataFrame, vault: DataFrame) -> DataFrame:
    """(matter_id, label_type, canonical, label, how) of values that a vault (matter_id, label_type, canonical, label) knows:
    exactly, by folding, a company by the first two words or more of its name, a person by a last name alone or by first and
    last name. A way that leads to several labels leads to none; the first way that leads to one counts.

    Candidates meet on the folded first or last word, never all against all.
    """
    keys = ["matter_id", "label_type"]
    words = lambda c: F.split(ascii_lower(F.col(c)), " +")
    v = values.select(*keys, "canonical").distinct().withColumn("w", words("canonical"))
    k = vault.select(*keys, F.col("canonical").alias("known"), "label").withColumn("kw", words("known"))

    def one(pairs: DataFrame, how: str, order: int) -> DataFrame:
        met = pairs.groupBy(*keys, "canonical").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        return met.where("label = other").select(*keys, "canonical", "label", F.lit(how).alias("how"), F.lit(order).alias("order"))

    exact = one(v.join(k.withColumnRenamed("known", "canonical"), [*keys, "canonical"]), "exact", 0)
    fold = one(v.withColumn("f", ascii_fold(F.col("canonical"))).join(k.withColumn("f", ascii_fold(F.col("known"))), [*keys, "f"]), "folded", 1)
    starts = (F.size("w") >= 2) & (F.size("kw") >= 2) & (F.startswith(F.concat_ws(" ", "w"), F.concat(F.concat_ws(" ", "kw"), F.lit(" "))) | F.startswith(F.concat_ws(" ", "kw"), F.concat(F.concat_ws(" ", "w"), F.lit(" "))))
    company = one(v.where("label_type = 'SIRKET'").withColumn("h", F.col("w")[0]).join(k.withColumn("h", F.col("kw")[0]), [*keys, "h"]).where(starts), "company", 2)
    last = lambda c: F.element_at(c, -1)
    people, known = v.where("label_type = 'KISI'").withColumn("h", last(F.col("w"))), k.withColumn("h", last(F.col("kw")))
    met = people.join(known, [*keys, "h"])
    alone = one(met.where((F.size("w") == 1) & (F.length("h") >= 3)), "last name", 3)
    ends = one(met.where((F.size("w") > 1) & (F.size("kw") > 1) & (F.col("w")[0] == F.col("kw")[0])), "first and last name", 4)
    every = exact.unionByName(fold).unionByName(company).unionByName(alone).unionByName(ends)
    return every.groupBy(*keys, "canonical").agg(F.min_by(F.struct("label", "how"), "order").alias("x")).select(*keys, "canonical", "x.label", "x.how")
