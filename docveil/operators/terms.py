"""Defined terms and parties: guards for detection, undefined terms, spellings and roles of parties."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions.textfold import ascii_lower, company_core
from docveil.operators.audit import DEFINITION, defined_terms
from docveil.operators.match import overlap, spans
from docveil.operators.rules import CAPITAL, FINDINGS, FORMS, NAME, SMALL
from docveil.operators.scan import RESIDUAL_SCORE, RESIDUALS

#: A name that follows a definition by at most so many letters counts as its inflection.
INFLECTED = 4
#: Spellings of one party: alike at least so much, but not the same, and at least so long.
ALIKE, LONG = 0.86, 6
#: Furthest place of a party before its role in parentheses.
ROLE_DISTANCE = 250
TOP_TERMS = 12
#: Where a run of capitalised words begins inside of a sentence: after a comma or a word of small letters.
INSIDE = f"(?=[{CAPITAL}])(?:(?<=, )|(?<=(?<![{CAPITAL}{SMALL}'’-])[{SMALL}'’-]{{1,30}} ))"


def definitions(text: Column) -> Column:
    """The folded terms that a text defines in quotes. To be a column of its own before it is used for each finding."""
    return F.transform(spans(text, DEFINITION), lambda s: ascii_lower(F.regexp_replace(s["text"], '["“”]', "")))


def without_defined(candidates: Column, defined: Column) -> Column:
    """Drops persons and companies that are a defined term, also inflected or as its first words."""

    def is_term(f: Column) -> Column:
        folded = ascii_lower(f["text"])
        return F.exists(defined, lambda t: (F.startswith(folded, t) & (F.length(folded) <= F.length(t) + INFLECTED)) | F.startswith(t, F.concat(folded, F.lit(" "))))

    return F.filter(candidates, lambda f: ~f["entity"].isin("PERSON", "TR_TUZEL_KISI") | ~is_term(f))


#: A published foreign decision: parties with v, a year in brackets. Fixed values.
FOREIGN = r"[A-Z][\w’'.&-]*(?: [A-Z][\w’'.&-]*){0,4} v[.]? [A-Z][\w’'.&-]*(?: [A-Z][\w’'.&-]*){0,4},? [\[(][0-9]{4}[\])]"


def foreign_citations(text: Column) -> Column:
    """The places of such decisions in a text; `filters.outside` drops what lies inside of them."""
    return spans(text, FOREIGN)


def residual_candidates(text: Column, kept: Column, suspects: Column) -> Column:
    """What the residual patterns find in an original text beside findings and suspects: to be reviewed, score 45. Of
    overlapping ones the earlier pattern's stay."""
    found = F.concat(
        *(
            F.transform(spans(text, p), _residual(kind))
            for kind, p in RESIDUALS
        )
    ).cast(FINDINGS)
    free = F.filter(found, lambda f: ~F.exists(kept, lambda k: overlap(f, k)) & ~F.exists(suspects, lambda k: overlap(f, k)))
    return F.aggregate(free, F.array().cast(FINDINGS), lambda acc, f: F.when(F.exists(acc, lambda k: overlap(k, f)), acc).otherwise(F.concat(acc, F.array(f))))


def _residual(kind: str):
    return lambda s: F.struct(s["start"], s["end"], F.lit("ARTIK").alias("entity"), F.lit(kind).alias("label_type"), F.lit(RESIDUAL_SCORE).alias("score"), s["text"], s["text"].alias("canonical"), F.lit("residual").alias("source"))


def undefined_terms(rows: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """(doc_id, term_key, n): capitalised words and runs inside of sentences that no definition has, at least 3 times (2 for
    several words), in documents with two definitions or more; each document's `most` most frequent ones."""
    defined = defined_terms(rows).select("doc_id", "term_key").distinct()
    several = defined.groupBy("doc_id").count().where("count >= 2").select("doc_id")
    # what is found is small, so it meets the documents' definitions after it is counted; texts are not shuffled
    found = rows.select("doc_id", F.inline(spans(F.col("text"), rf"{INSIDE}{NAME}(?: {NAME})*")))
    counted = found.select("doc_id", ascii_lower(F.col("text")).alias("term_key")).groupBy("doc_id", "term_key").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.where(F.col("n") >= F.when(F.contains("term_key", F.lit(" ")), 2).otherwise(3)).join(several, "doc_id", "left_semi").join(defined, ["doc_id", "term_key"], "left_anti")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term_key"))
    return frequent.withColumn("k", k).where(F.col("k") <= most).drop("k")


def _grams(name: Column) -> Column:
    """The pairs of neighbouring letters of a name and its two edges, each with the number of times that it came before."""
    padded = F.concat(F.lit("<"), name, F.lit(">"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))


def spellings(names: DataFrame, least: float = ALIKE) -> DataFrame:
    """(doc_id, a, b): distinct names (doc_id, name) of a document that are at least so much alike, but not the same and not the
    other's beginning; a is the smaller one. Every such pair is found.

    Likeness is 2m / (|a| + |b|) for m letters in common, in order. Turning a into b takes |a| - m letters out, each of which ends
    two of a's |a| + 1 pairs of neighbours, and puts |b| - m in, which end one each. So at least 1 + (1.5 least - 1)(|a| + |b|) pairs
    are left in both, and |b| is at least |a| least / (2 - least). Of a's pairs, in order of how rare they are in the document, one
    of the first ones is thus among the first ones of b. Below a likeness of 2/3 this says nothing, and is refused.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least is above 2/3 and at most 1")
    share = 1.5 * least - 1
    # a document with one name has no pair
    sets = names.select("doc_id", "name").where("name <> ''").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    rows = sets.where(F.size("names") > 1).select("doc_id", F.explode("names").alias("name")).withColumn("grams", _grams(F.col("name")))
    each = rows.select("doc_id", "name", F.explode("grams").alias("gram"))
    rare = each.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # pairs that only one name has lead nowhere, but take their places among the first ones
    ranked = each.join(rare, ["doc_id", "gram"], "left").groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "gram"))).alias("order"))
    fewest = F.ceil(1 + share * (1 + least / (2 - least)) * F.length("name") - 1e-9)
    first = F.slice("order", F.lit(1), F.greatest(F.size("order") - fewest + 1, F.lit(0)).cast("int"))
    keys = ranked.select("doc_id", "name", F.explode(F.filter(first, lambda x: x["n"] > 1)).alias("x")).select("doc_id", "name", F.col("x.gram").alias("gram"), F.length("name").alias("size"))
    a, b = (keys.select("doc_id", "gram", F.col("name").alias(side), F.col("size").alias(f"size_{side}")) for side in "ab")
    near = (2 * F.least("size_a", "size_b") >= least * (F.col("size_a") + F.col("size_b")) - 1e-9) & F.expr("a < b and not startswith(b, a)")
    met = a.join(b, ["doc_id", "gram"]).where(near).select("doc_id", "a", "b").distinct()
    common = F.size(F.array_intersect(_grams(F.col("a")), _grams(F.col("b"))))
    pairs = met.where(common >= 1 + share * (F.length("a") + F.length("b")) - 1e-9)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[least <= SequenceMatcher(None, a, b, autojunk=False).ratio() < 1 for a, b in zip(f["a"], f["b"])]]

    return pairs.mapInPandas(run, pairs.schema)


def party_spellings(rows: DataFrame) -> DataFrame:
    """(doc_id, a, b): companies of a document whose names differ by a slip, wherever it is."""
    found = rows.select("doc_id", F.inline(spans(F.col("text"), rf"(?:{NAME} ){{1,7}}{FORMS}"))).select("doc_id", company_core(F.col("text")).alias("name"))
    return spellings(found.where(F.length("name") >= LONG))


def role_conflicts(rows: DataFrame) -> DataFrame:
    """(doc_id, role, parties): roles in parentheses and quotes that a document gives to several companies. A role belongs to
    the last company that ends at most ROLE_DISTANCE characters before it, with no `)` between."""
    role = rf'[(][^()"“]{{0,30}}["“][{CAPITAL}][{SMALL}]+["”][)]'
    roles = rows.select("doc_id", "p_idx", "text", F.inline(F.transform(spans(F.col("text"), role), lambda s: F.struct(s["start"].alias("at"), F.regexp_extract(s["text"], '["“]([^"”]+)["”]', 1).alias("role")))))
    names = F.filter(spans(F.col("text"), rf"(?:{NAME} ){{1,7}}{FORMS}"), lambda s: (s["end"] <= F.col("at")) & (F.col("at") - s["end"] <= ROLE_DISTANCE) & ~F.contains(F.substring(F.col("text"), s["end"] + 1, F.col("at") - s["end"]), F.lit(")")))
    owned = roles.select("doc_id", ascii_lower(F.col("role")).alias("role"), company_core(F.try_element_at(names, F.lit(-1))["text"]).alias("party")).where("party is not null")
    return owned.groupBy("doc_id", "role").agg(F.sort_array(F.collect_set("party")).alias("parties")).where(F.size("parties") > 1)
