"""Overlap resolution and propagation of found values over a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.functions.names import GIVEN
from docveil.functions.textfold import tr_lower
from docveil.operators.match import SPAN, let, overlap, spans
from docveil.operators.rules import CAPITAL, FINDINGS, FORMS, THRESHOLD


def resolve(candidates: Column) -> Column:
    """A greedy choice of disjoint findings, in order of place. Dictionary entries come first, then higher scores, longer ones,
    those found themselves before propagated ones, then the earlier, then by entity and canonical value."""

    def rank(f: Column) -> Column:
        return F.struct(
            F.when(f["source"] == "dictionary", 0).otherwise(1).alias("a"), (-f["score"]).alias("b"), (f["start"] - f["end"]).alias("c"),
            F.when(f["source"] == "propagated", 1).otherwise(0).alias("d"), f["start"].alias("e"), f["entity"].alias("g"), f["canonical"].alias("h"), f.alias("f"),
        )

    ranked = F.transform(F.array_sort(F.transform(candidates, rank)), lambda r: r["f"])
    kept = F.aggregate(ranked, F.array().cast(FINDINGS), lambda acc, f: F.when(F.exists(acc, lambda k: overlap(k, f)), acc).otherwise(F.concat(acc, F.array(f))))
    return F.array_sort(kept)


WORD = "[\\p{L}\\p{N}_]"
#: Words of a trade; a company's name up to one of them may stand for it. Fixed values.
TRADES = ("enerji", "inşaat", "lojistik", "holding", "sigorta", "gıda", "tekstil", "turizm", "otomotiv", "yazılım", "teknoloji", "madencilik", "bankası", "sanayi", "makina", "elektrik", "sağlık", "ilaç")

#: One pattern instead of a list of literals, which would be copied wherever it is used.
GIVEN_NAME, TRADE = (f"^(?:{'|'.join(names)})$" for names in (GIVEN, TRADES))


def literal_spans(text: Column, value: Column, any_case: bool = True) -> Column:
    """Places of a literal value (a column) in text, whole words with any white space between them, left to right without
    overlap; in any case, or as it is written."""
    words = F.filter(F.split(value, "[ \t\r\n]+"), lambda w: w != "")
    body = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.regexp_replace(w, r"\\E", ""), F.lit("\\E"))), "[ \t\r\n]+")
    pattern = F.concat(F.lit(f"{'(?iu)' if any_case else ''}(?<!{WORD})"), body, F.lit(f"(?!{WORD})"))
    return F.when(F.size(words) > 0, spans(text, pattern)).otherwise(F.array().cast(f"array<{SPAN}>"))


def short_forms(company: Column) -> Column:
    """A company's name without its legal form, if that leaves at least two words, and its beginnings that end with a trade."""
    body = F.regexp_replace(company, f"(?iu)[ ,]+{FORMS}[ ,.]*$", "")
    words = F.split(body, "[ \t\r\n]+")
    n = F.size(words)
    ends = F.filter(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: (i < n) & tr_lower(F.get(words, i - 1)).rlike(TRADE))
    beginnings = F.transform(ends, lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    whole = F.when(n >= 2, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(body != company, F.array_distinct(F.concat(whole, beginnings))).otherwise(F.array().cast("array<string>"))


def propagate(text: Column, kept: Column) -> Column:
    """Findings of kept values wherever else they stand in the same document: persons, companies and dictionary values whole,
    in any case; a company's short forms; a person's surname in capitals and given name, as they are written, if just one
    person has them. They keep the type; the scores of parts of a person's name are at most 70.

    Values of fewer than 3 characters, without a capital, and single words of a person that are neither a given name nor in
    capitals stay where they are; dictionary values always go on.
    """
    capital = lambda t: t.rlike(f"(?:^|[ ])[{CAPITAL}]")
    words = lambda f: F.split(f["text"], "[ \t\r\n]+")
    own = lambda f: (F.size(words(f)) > 1) | f["text"].rlike(GIVEN_NAME) | f["text"].rlike(f"^[{CAPITAL}]{{3,}}$")
    proper = lambda f: (F.length(f["text"]) >= 3) & capital(f["text"]) & ((f["entity"] != "PERSON") | own(f))
    eligible = F.filter(kept, lambda f: (f["entity"] == "SOZLUK") | f["entity"].isin("PERSON", "TR_TUZEL_KISI") & proper(f))
    distinct = F.aggregate(
        eligible, F.array().cast(FINDINGS), lambda acc, f: F.when(F.exists(acc, lambda k: (k["canonical"] == f["canonical"]) & (k["label_type"] == f["label_type"]) & (k["text"] == f["text"])), acc).otherwise(F.concat(acc, F.array(f)))
    )
    surname = lambda f: F.when(F.element_at(words(f), -1).rlike(f"^[{CAPITAL}'’-]{{3,}}$"), F.element_at(words(f), -1)).otherwise("")
    given = lambda f: F.when(F.element_at(words(f), 1).rlike(GIVEN_NAME), F.element_at(words(f), 1)).otherwise("")
    score = lambda f: F.greatest(F.least(f["score"], F.lit(70)), F.lit(THRESHOLD))

    def elsewhere(people: Column, part) -> Column:
        """Where the part of a name that just one person has stands."""
        alone = F.filter(people, lambda f: (part(f) != "") & (F.size(F.array_distinct(F.transform(F.filter(people, lambda g: part(g) == part(f)), lambda g: g["canonical"]))) == 1))
        return F.flatten(F.transform(alone, lambda f: F.transform(literal_spans(text, part(f), False), lambda s: _finding(s, f, score(f)))))

    def every(values: Column) -> Column:
        whole = F.flatten(F.transform(values, lambda f: F.transform(literal_spans(text, f["text"]), lambda s: _finding(s, f, f["score"]))))
        companies = F.filter(values, lambda f: f["entity"] == "TR_TUZEL_KISI")
        short = F.flatten(F.transform(companies, lambda f: F.flatten(F.transform(short_forms(f["text"]), lambda v: F.transform(literal_spans(text, v), lambda s: _finding(s, f, f["score"]))))))
        people = F.filter(values, lambda f: (f["entity"] == "PERSON") & (F.size(words(f)) > 1))
        return F.concat(whole, short, let(people, lambda p: elsewhere(p, surname)), let(people, lambda p: elsewhere(p, given)))

    return let(distinct, lambda values: F.when(F.size(values) > 0, every(values)).otherwise(F.array().cast(FINDINGS)))


def _finding(s: Column, f: Column, score: Column) -> Column:
    return F.struct(
        s["start"], s["end"], f["entity"].alias("entity"), f["label_type"].alias("label_type"), score.cast("int").alias("score"),
        s["text"], f["canonical"].alias("canonical"), F.lit("propagated").alias("source"),
    ).cast(FINDINGS[len("array<") : -1])
