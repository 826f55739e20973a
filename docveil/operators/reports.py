"""Findings in their place: paragraphs, excerpts, masked views, and a document's audit as one ordered list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.operators import audit, figures, terms

#: Characters on both sides of a finding that its excerpt shows.
AROUND = 80
#: What an audit rule weighs. Fixed values.
SEVERITY = {"missing_reference": "high", "party_form": "high", "role_conflict": "high", "party_spelling": "medium", "unused_term": "medium", "undefined_term": "low"}
ORDER = {"high": 0, "medium": 1, "low": 2}


def located(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """findings (doc_id, start, ...) with `p_idx`, the last paragraph of rows (doc_id, p_idx, start) that begins at or before
    it, and `at`, its place there; null before the first paragraph.

    An as-of join by one window over a document's places: paragraphs and findings do not meet pair by pair.
    """
    names = [c for c in findings.columns if c != "doc_id"]
    marks = rows.select("doc_id", F.col("start").alias("__place"), F.lit(0).alias("__kind"), F.struct("p_idx", F.col("start").alias("begin")).alias("__mark"), F.lit(None).cast(findings.select(F.struct(*names)).schema[0].dataType).alias("__finding"))
    asked = findings.select("doc_id", F.col("start").alias("__place"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__mark"].dataType).alias("__mark"), F.struct(*names).alias("__finding"))
    last = F.last("__mark", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("__place", "__kind"))
    placed = marks.unionByName(asked).withColumn("__mark", last).where("__kind = 1")
    return placed.select("doc_id", "__finding.*", "__mark.p_idx", (F.col("__place") - F.col("__mark.begin")).alias("at"))


def excerpt(text: Column, start: Column, end: Column, around: int = AROUND) -> Column:
    """What stands around a place, widened to whole words, with … where text goes on."""
    first, last = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    first = first - F.length(F.regexp_extract(F.substring(text, F.lit(1), first), r"\S*\z", 0))
    last = last + F.length(F.regexp_extract(F.substring(text, last + 1, F.length(text)), r"^\S*", 0))
    shown = F.trim(F.regexp_replace(F.substring(text, first + 1, last - first), r"^\s+|\s+$", ""))
    return F.concat(F.when(first > 0, "…").otherwise(""), shown, F.when(last < F.length(text), "…").otherwise(""))


def masked_view(text: Column, start: Column, end: Column, edits: Column) -> Column:
    """text from start to end with edits array<struct<start, end, replacement>> (disjoint) applied; of an edit that the place
    cuts through, the whole label stands there, so that no part of a value goes out."""
    inside = F.array_sort(F.filter(edits, lambda e: (e["start"] < end) & (start < e["end"])), lambda a, b: a["start"] - b["start"])
    begin = F.struct(start.cast("int").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(e["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], e["end"]).cast("int").alias("at"), F.concat(acc["out"], kept, e["replacement"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0))))
    return F.aggregate(inside, begin, step, rest)


def audit_findings(docs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, no, rule, severity, p_idx, value): what the audit rules find in docs (doc_id, text), the gravest first, then in
    order of place, rule and value. What is found about a whole document has no p_idx and comes after what has one. With the cells
    of its tables (as `figures.table_rows` takes them), so does what bilingual rows have on one side only."""
    rows = audit.paragraphs(docs)
    none = F.lit(None).cast("int")

    def of(rule: str, found: DataFrame, value: Column, p_idx: Column = none, start: Column = none) -> DataFrame:
        return found.select("doc_id", F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), p_idx.alias("p_idx"), start.alias("__start"), value.alias("value"))

    every = [
        of("missing_reference", audit.missing_references(rows), F.col("path"), F.col("p_idx"), F.col("start")),
        of("party_form", audit.party_forms(rows), F.concat("core", F.lit(": "), F.array_join("forms", ", "))),
        of("role_conflict", terms.role_conflicts(rows), F.concat("role", F.lit(": "), F.array_join("parties", ", "))),
        of("party_spelling", terms.party_spellings(rows), F.concat("a", F.lit(", "), F.col("b"))),
        of("unused_term", audit.unused_terms(rows), F.col("term")),
        of("undefined_term", terms.undefined_terms(rows), F.col("term_key")),
    ]
    if cells is not None:
        place = F.concat(F.lit("table "), "table_id", F.lit(", row "), "row", F.lit(": "), F.array_join("only_left", ", "), F.lit(" | "), F.array_join("only_right", ", "))
        found = figures.bilingual_findings(cells)
        every.append(found.select("doc_id", F.concat(F.lit("bilingual_"), "kind").alias("rule"), "severity", none.alias("p_idx"), none.alias("__start"), place.alias("value")))
    weight = reduce(lambda w, s: w.when(F.col("severity") == s, ORDER[s]), list(ORDER)[1:], F.when(F.col("severity") == "high", 0))
    order = Window.partitionBy("doc_id").orderBy(weight, F.asc_nulls_last("p_idx"), F.asc_nulls_last("__start"), "rule", "value")
    return reduce(DataFrame.unionByName, every).withColumn("no", F.row_number().over(order)).select("doc_id", "no", "rule", "severity", "p_idx", "value")


def roll_up(findings: DataFrame) -> DataFrame:
    """(doc_id, total, high, medium, low) of audit findings."""
    return findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ORDER))
