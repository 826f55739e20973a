"""Labels for found values, kept in a vault by matter: numbering, masking, lenient reading back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions.morphology import inflected
from docveil.functions.textfold import ascii_fold
from docveil.operators.match import SPAN, splice, spans

#: A label as texts come back: white space inside, up to 5 digits, a type of up to 40 characters.
LABEL = r"\{\{[ ]*[^\s{}]{1,40}[ ]*-[ ]*[0-9]{1,5}[ ]*\}\}"
#: An apostrophe and endings after a label.
ENDING = "['’][a-zçğıöşü]{1,12}(?![A-Za-zÇĞİÖŞÜçğıöşüâîû0-9_])"


def shown(label_type: Column, number: Column) -> Column:
    return F.concat(F.lit("{{"), label_type, F.lit("-"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")), F.lit("}}"))


def folded(label: Column) -> Column:
    """What equal labels share: type without diacritics and case, the number without leading zeros."""
    body = ascii_fold(F.regexp_replace(label, r"[{}\s]", ""))
    return F.concat(F.regexp_extract(body, "^(.*)-0*[0-9]+$", 1), F.lit("-"), F.regexp_extract(body, "-0*([0-9]+)$", 1))


def number_values(findings: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """(matter_id, label_type, canonical, number, label, values): one row a value. Values that a vault has keep their number;
    new ones follow in order of their first place (doc_id, start) in the matter.

    Findings are reduced to one row a value before any value is ranked.
    """
    first = findings.groupBy("matter_id", "label_type", "canonical").agg(F.min(F.struct("doc_id", "start")).alias("__first"), F.collect_set("text").alias("values"))
    order = Window.partitionBy("matter_id", "label_type").orderBy("__first", "canonical")
    if vault is None:
        numbered = first.withColumn("number", F.row_number().over(order))
    else:
        known = vault.select("matter_id", "label_type", "canonical", F.col("number").alias("__known"))
        top = vault.groupBy("matter_id", "label_type").agg(F.max("number").alias("__top"))
        both = first.join(known, ["matter_id", "label_type", "canonical"], "left").join(top, ["matter_id", "label_type"], "left")
        fresh = Window.partitionBy("matter_id", "label_type", F.col("__known").isNull()).orderBy("__first", "canonical")
        numbered = both.withColumn("number", F.coalesce("__known", F.coalesce("__top", F.lit(0)) + F.row_number().over(fresh)))
    return numbered.select("matter_id", "label_type", "canonical", F.col("number").cast("int").alias("number"), shown(F.col("label_type"), F.col("number")).alias("label"), F.sort_array("values").alias("values"))


def mask(docs: DataFrame, findings: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, matter_id, text) with `masked`, each finding replaced by its value's label."""
    edits = findings.join(labels.select("matter_id", "label_type", "canonical", "label"), ["matter_id", "label_type", "canonical"])
    edits = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.col("label").alias("replacement"))).alias("__edits"))
    return docs.join(edits, "doc_id", "left").withColumn("masked", F.when(F.col("__edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("__edits")))).drop("__edits")


def labels_in(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a label in texts (doc_id, matter_id, text): start, end, the label as it stands, and folded."""
    return texts.where(F.contains(F.col(text), F.lit("{{"))).select("doc_id", "matter_id", F.inline(spans(F.col(text), LABEL))).withColumn("folded", folded(F.col("text")))


def main_value(values: Column) -> Column:
    """The longest of a value's forms, of equally long ones the first."""
    return F.element_at(F.array_sort(values, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))), 1)


def read_back(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """texts (doc_id, matter_id, text) with `unmasked`, `resolved` (how many labels the vault has) and `unknown` (the others, sorted).
    Labels, also damaged ones, are replaced by their value's longest form; endings after an apostrophe follow that form's harmony.
    Texts without labels are given back as they are: only the others meet their labels, once."""
    t, none = F.col(text), F.array().cast(f"array<{SPAN}>")
    rows = texts.withColumn("__labels", F.when(F.contains(t, F.lit("{{")), spans(t, f"{LABEL}(?:{ENDING})?")).otherwise(none))
    some = rows.where(F.size("__labels") > 0)
    known = labels.select("matter_id", folded(F.col("label")).alias("folded"), main_value(F.col("values")).alias("value"), F.lit(True).alias("__known"))
    written = some.select("doc_id", "matter_id", F.inline("__labels")).withColumns({"__tail": F.regexp_extract("text", f"{ENDING}$", 0), "text": F.regexp_extract("text", LABEL, 0)})
    met = written.withColumn("folded", folded(F.col("text"))).join(known, ["matter_id", "folded"], "left")
    shown = F.when(F.col("__tail") == "", F.col("value")).otherwise(F.concat("value", F.substring("__tail", 1, 1), inflected(F.col("value"), F.substring("__tail", 2, 15))))
    edits = F.collect_list(F.when(F.col("__known"), F.struct("start", "end", shown.alias("replacement"))))
    lost = F.collect_set(F.when(F.col("__known").isNull(), F.col("text")))
    done = met.groupBy("doc_id").agg(edits.alias("__edits"), F.sort_array(lost).alias("unknown"))
    out = some.drop("__labels").join(done, "doc_id", "left")
    # two values of one label are no text
    places = F.size(F.array_distinct(F.transform("__edits", lambda e: e["start"])))
    back = out.withColumns({"unmasked": F.when(places > 0, splice(t, F.col("__edits"))).otherwise(t), "resolved": F.coalesce(places, F.lit(0)), "unknown": F.coalesce("unknown", F.array().cast("array<string>"))})
    plain = rows.where(F.size("__labels") == 0).drop("__labels").withColumns({"unmasked": t, "resolved": F.lit(0), "unknown": F.array().cast("array<string>")})
    return plain.unionByName(back.drop("__edits"))


def unmask(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """texts with `unmasked` (see `read_back`). Unknown labels stay."""
    return read_back(texts, labels, text).drop("resolved", "unknown")


def unknown_labels(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, label) of labels that no vault row resolves."""
    known = labels.select("matter_id", folded(F.col("label")).alias("folded"))
    return labels_in(texts, text).join(known, ["matter_id", "folded"], "left_anti").select("doc_id", F.col("text").alias("label")).distinct()
