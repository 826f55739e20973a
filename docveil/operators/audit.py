"""Consistency of contracts: language, paragraphs, defined terms, cross-references, parties, amounts and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions.textfold import MARKED, PLAIN, ascii_lower, company_core
from docveil.operators.match import let, spans
from docveil.operators.rules import CAPITAL, FORMS, NAME, SMALL

#: Frequent function words by language. Fixed values.
STOP_WORDS = {
    "en": "the of and to in is that for it on was as with be by at from this are or an not have has".split(),
    "fr": "le la les de des du et un une en que qui dans est pour par sur avec au aux ne pas ce il".split(),
    "de": "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an".split(),
    "es": "el la los las de y que en un una es por con para del se no al lo como su más o".split(),
    "tr": "ve bir bu ile için da de olarak olan ise veya her gibi daha kadar".split(),
    "az": "və bir bu ilə üçün da də olaraq olan isə həm hər kimi daha qədər".split(),
}
#: Words with ə that tell Azerbaijani from Turkish: one in so many.
MARKED_WORDS = 20
SHARE = 0.04
AHEAD = 1.5


def language_counts(text: Column, languages: tuple[str, ...]) -> Column:
    """struct<total, marked, a number for each language>: words, those with ə, and function words. Counts of texts add up."""
    # split at one character, which needs no pattern; empty words are no words of any kind
    parts = F.split(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), "\t\r\n", F.lower(text)), " ")
    every = sorted({w for x in languages for w in STOP_WORDS[x]})

    # all words are looked at once, those of some language once more for each
    def counted(x: Column) -> Column:
        among = lambda stop_words: F.size(F.filter(x["some"], lambda w: w.isin(stop_words)))
        return F.struct(x["total"].alias("total"), x["marked"].alias("marked"), *(among(STOP_WORDS[n]).alias(n) for n in languages))

    def read(words: Column) -> Column:
        marked = F.when(F.contains(F.lower(text), F.lit("ə")), F.size(F.filter(words, lambda w: F.contains(w, F.lit("ə"))))).otherwise(0) if "az" in languages else F.lit(0)
        return let(F.struct(F.filter(words, lambda w: w.isin(every)).alias("some"), F.size(F.array_remove(words, "")).alias("total"), marked.alias("marked")), counted)

    return let(parts, read)


def language_of(counts: Column, languages: tuple[str, ...]) -> Column:
    """The language that language_counts, or their sums, tell. With az among the languages, one word with ə in MARKED_WORDS decides
    between it and Turkish."""
    total, by = counts["total"], {x: counts[x] for x in languages}
    if "az" in languages:
        azerbaijani = counts["marked"] * MARKED_WORDS >= total
        by |= {x: F.when(azerbaijani == (x == "az"), by[x]).otherwise(0) for x in ("az", "tr") if x in by}
    best = F.greatest(*by.values())
    pick = F.lit(None).cast("string")
    for x in sorted(languages, reverse=True):
        next_best = F.greatest(*(c for y, c in by.items() if y != x), F.lit(0))
        pick = F.when((by[x] == best) & (by[x] * 2 >= next_best * 3), x).otherwise(pick)
    return F.when((total >= 3) & (best * 25 >= total), pick)


def language(text: Column, languages: tuple[str, ...] = ("en", "fr", "de", "es")) -> Column:
    """The language most of whose function words stand in text: at least SHARE of its words, and AHEAD times the next;
    null for fewer than 3 words or without such a language."""
    return let(language_counts(text, languages), lambda counts: language_of(counts, languages))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, p_idx, start, text): a document's lines that are not blank, with their places."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    placed = F.aggregate(lines, begin, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), x.alias("text")))).alias("out")), lambda a: a["out"])
    rows = docs.select("doc_id", F.posexplode(placed).alias("p_idx", "__p"))
    return rows.where(F.trim("__p.text") != "").select("doc_id", "p_idx", "__p.*")


DEFINITION = rf'["“](?:{NAME}|[{CAPITAL}][{SMALL}]*)(?: [^\s"”“]+){{0,5}}["”]'


def defined_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, p_idx, start, term, term_key): quoted definitions of up to six words in paragraphs."""
    found = rows.select("doc_id", "p_idx", F.inline(spans(F.col("text"), DEFINITION)))
    term = F.regexp_replace(F.col("text"), '["“”]', "")
    return found.select("doc_id", "p_idx", "start", term.alias("term"), ascii_lower(term).alias("term_key"))


def unused_terms(rows: DataFrame, longest: int = 6) -> DataFrame:
    """Definitions whose term stands nowhere else in its document, also not inflected (up to 6 more letters)."""
    words = lambda t: F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    term = lambda s: F.regexp_replace(s["text"], '["“”]', "")
    terms = F.transform(spans(F.col("text"), DEFINITION), lambda s: F.struct(term(s).alias("term"), ascii_lower(term(s)).alias("term_key")))
    # a document's paragraphs meet in one row, as they came; a run of words does not go over a line
    own = rows.select("doc_id", terms.alias("__terms"), words(ascii_lower(F.col("text"))).alias("__words"))
    own = own.groupBy("doc_id").agg(F.flatten(F.collect_list("__terms")).alias("__terms"), F.array_join(F.collect_list("__words"), "\n").alias("__words"))

    def once(t: Column) -> Column:
        def uses(key: Column) -> Column:
            # terms of fewer than four letters are not inflected; places overlap, so they are looked at ahead
            more = F.when(F.length(key) < 4, "").otherwise("[a-z0-9]{0,6}")
            return F.regexp_count("__words", F.concat(F.lit("(?<![a-z0-9])(?="), key, more, F.lit("(?![a-z0-9]))")))

        return let(words(t["term_key"]), lambda key: (F.size(F.split(key, " ")) > longest) | (uses(key) <= 1))

    unused = own.select("doc_id", F.inline(F.filter("__terms", once)))
    return unused.groupBy("doc_id", "term_key").agg(F.min("term").alias("term")).select("doc_id", "term", "term_key")


REFERENCE = r"(?i:section|article|clause|madde) [0-9]+(?:[.][0-9]+)*"
HEADING = r"^ *(?:(?i:section|article|clause|madde) +)?([0-9]+(?:[.][0-9]+)*)[.):]? +"


def references(rows: DataFrame) -> DataFrame:
    """(doc_id, p_idx, start, path): references to numbered parts, not counting a paragraph's own number."""
    found = rows.select("doc_id", "p_idx", F.inline(spans(F.col("text"), REFERENCE)))
    return found.where("start > 0").select("doc_id", "p_idx", "start", F.regexp_extract("text", r"([0-9.]+)$", 1).alias("path"))


def missing_references(rows: DataFrame) -> DataFrame:
    """References to parts that their document does not have; documents without numbered parts are left alone."""
    parts = rows.select("doc_id", F.regexp_extract("text", HEADING, 1).alias("path")).where("path <> ''").distinct()
    numbered = parts.select("doc_id").distinct()
    return references(rows).join(numbered, "doc_id", "left_semi").join(parts, ["doc_id", "path"], "left_anti")


def party_forms(rows: DataFrame) -> DataFrame:
    """(doc_id, core, forms): companies that a document writes with several legal forms."""
    name = rf"(?:{NAME} ){{1,7}}{FORMS}"
    found = rows.select("doc_id", F.inline(spans(F.col("text"), name)))
    form = F.regexp_extract("text", rf"({FORMS})$", 1)
    return found.select("doc_id", company_core(F.col("text")).alias("core"), form.alias("form")).groupBy("doc_id", "core").agg(F.sort_array(F.collect_set("form")).alias("forms")).where(F.size("forms") > 1)


def number(text: Column) -> Column:
    """A number with Turkish or English separators as a decimal: the last separator is a decimal mark if one or two digits
    follow it, or if the other kind stands before it."""
    compact = F.regexp_replace(text, "[  ]", "")
    mark = F.regexp_extract(compact, "([.,])[0-9]{1,2}$", 1)
    both = F.regexp_extract(compact, "[.,].*([.,])[0-9]+$", 1)
    first = F.regexp_extract(compact, "([.,])", 1)
    decimal = F.when(mark != "", mark).when((both != "") & (both != first), both).otherwise(F.lit(""))
    whole = F.when(decimal == "", F.regexp_replace(compact, "[.,]", "")).when(decimal == ",", F.translate(F.regexp_replace(compact, "[.]", ""), ",", ".")).otherwise(F.regexp_replace(compact, ",", ""))
    return F.when(compact.rlike("^[0-9][0-9.,]*$"), whole.try_cast("decimal(20,4)"))


MONTHS = {
    1: "january ocak yanvar", 2: "february şubat fevral", 3: "march mart", 4: "april nisan aprel", 5: "may mayıs", 6: "june haziran iyun",
    7: "july temmuz iyul", 8: "august ağustos avqust", 9: "september eylül sentyabr", 10: "october ekim oktyabr", 11: "november kasım noyabr", 12: "december aralık dekabr",
}
_FOLDED = {n.translate(str.maketrans(MARKED, PLAIN)): k for k, names in MONTHS.items() for n in names.split()}
_SHORT = {n[:3]: {k for m, k in _FOLDED.items() if m[:3] == n[:3]} for n in _FOLDED}
#: Months' names, folded, and their first three letters where these tell one month.
MONTH_NAMES = {n: min(k) for n, k in _SHORT.items() if len(k) == 1} | {"sept": 9} | _FOLDED


def date(text: Column) -> Column:
    """yyyy-mm-dd, dd.mm.yyyy (also / and -), `d Month yyyy` and `Month d, yyyy` in three languages, as a date; else null. Months
    may be short (`Sept.`, `Oca`).
    An English day and month change places only if that is the only way to read them."""
    return let(ascii_lower(F.trim(text)), folded_date)


def folded_date(t: Column) -> Column:
    """`date` of a text that is folded and trimmed: what reads it more than once is plain columns."""
    numeric = "^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([1-9][0-9]{3})$"
    names = F.create_map(*(F.lit(v) for pair in MONTH_NAMES.items() for v in pair))
    first, second = r"^([0-9]{1,2})[.]? ([\p{L}]+)[.]?,? ([1-9][0-9]{3})$", r"^([\p{L}]+)[.]? ([0-9]{1,2}),? ([1-9][0-9]{3})$"
    swapped = lambda pattern, order: F.regexp_replace(t, pattern, order).try_cast("date")
    worded = lambda pattern, month, day: F.concat(F.regexp_extract(t, pattern, 3), F.lit("-"), F.try_element_at(names, F.regexp_extract(t, pattern, month)).cast("string"), F.lit("-"), F.regexp_extract(t, pattern, day)).try_cast("date")
    return (
        F.when(t.rlike(numeric), F.coalesce(swapped(numeric, "$3-$2-$1"), swapped(numeric, "$3-$1-$2")))
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(first), worded(first, 2, 1))
        .when(t.rlike(second), worded(second, 1, 2))
    )


def bilingual_differences(cells: DataFrame) -> DataFrame:
    """(doc_id, row, kind, value, side): amounts and dates of a two-column table (doc_id, row, side 'left' or 'right', text)
    that only one side of a row has, counted as often as they stand there."""
    amount = r"[0-9]+(?:[.,][0-9]+)+"
    when = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} [\p{L}]+ [0-9]{4}|[\p{L}]+ [0-9]{1,2}, [0-9]{4}"
    dates = cells.select("doc_id", "row", "side", F.lit("date").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(f"({when})"), F.lit(1))).alias("v")).select("doc_id", "row", "side", "kind", date(F.col("v")).cast("string").alias("value"))
    rest = F.regexp_replace("text", when, " ")
    amounts = cells.select("doc_id", "row", "side", F.lit("amount").alias("kind"), F.explode(F.regexp_extract_all(rest, F.lit(f"({amount})"), F.lit(1))).alias("v")).select("doc_id", "row", "side", "kind", number(F.col("v")).cast("string").alias("value"))
    every = dates.unionByName(amounts).where("value is not null").groupBy("doc_id", "row", "kind", "value").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    return every.where("l <> r").select("doc_id", "row", "kind", "value", F.when(F.col("l") > F.col("r"), "left").otherwise("right").alias("side"))
