"""Dates, amounts, percentages and plain numbers of a text, and what the two columns of a bilingual table have of them.

A text is read in turn, the most particular first: own label, references, dates, amounts, percentages, numbers. What one of them
takes is put in marks that the next ones pass over, so that no character counts twice; all of it is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions.textfold import MARKED
from docveil.functions.textfold import PLAIN as FOLDED
from docveil.operators import audit, structure
from docveil.operators.match import let
from docveil.operators.staging import kept

#: Words and signs of currencies, folded, by their code. Fixed values. Longer words also stand with an ending.
CURRENCIES = {
    "AZN": ["azn", "₼", "manat"], "CHF": ["chf"], "CNY": ["cny"], "EUR": ["eur", "€", "avro", "euro"], "GBP": ["gbp", "£", "pound", "sterlin"],
    "JPY": ["jpy", "¥"], "RUB": ["rub", "₽"], "TRY": ["try", "tl", "₺", "turk lirasi", "lira"], "USD": ["usd", "us$", "$", "abd dolari", "amerikan dolari", "dolar", "dollar"],
}
_WORDS = {w: code for code, words in CURRENCIES.items() for w in words}
_LONGEST = sorted(_WORDS, key=lambda w: (-len(w), w))
_ESCAPED = {w: w.replace("$", "[$]") for w in _LONGEST}


def _by_first(patterns: dict[str, str]) -> str:
    """Patterns of words, tried in order, where those of other first characters are passed over at once."""
    first = dict.fromkeys(w[0] for w in patterns)
    return "(?:" + "|".join(f"(?=[{c}])(?:{'|'.join(p for w, p in patterns.items() if w[0] == c)})" for c in first) + ")"


CURRENCY = _by_first({w: _ESCAPED[w] + ("[a-z]{0,4}" if len(w) > 3 else "") for w in _LONGEST})
#: The first characters of what a pattern may match, looked at before anything else.
_BEGINS = "".join(sorted({w[0] for w in _LONGEST}))
#: Digits in groups of three (by points, commas or spaces that do not break), or not; then a fraction.
NUMBER = "(?:[0-9]{1,3}(?:[.,\u00a0\u202f][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]+)?)"
#: All that a number may be made of; where a pattern looks ahead by it, whatever follows the number is none of these.
_NUMBERS = "[0-9.,\u00a0\u202f]"
# a class of single Latin characters is looked up in a table, a range is not: it is asked first
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_BEFORE, _AFTER = rf"(?<![{_LETTERS}{_DIGITS}_.,])(?<!\p{{L}})", r"(?![\p{L}0-9_])"
_MONTH = _by_first({n: n for n in sorted(audit.MONTH_NAMES, key=lambda n: (-len(n), n))})
_MONTHS_BEGIN = "".join(sorted({n[0] for n in audit.MONTH_NAMES}))
# Most places fail by their first character, which is why it is taken before anything is asked of it: what stands before it, what the
# word or the number goes on with, and then, from one character back, what it must be. A word goes to its end, as does a number.
DATE = (
    rf"[{_MONTHS_BEGIN}](?<![{_LETTERS}].)(?=[a-z]*+[.]? [0-9])(?<=(?<!\p{{L}})(?={_MONTH}[.]? ).)[a-z]*+[.]? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}(?![0-9])"
    r"|[0-9](?<![0-9.].)(?:(?:[0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]?[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9])"
    rf"|[0-9]?(?:st|nd|rd|th|[.])? (?=[a-z]++[.]?,? [0-9]){_MONTH}[.]?,? [0-9]{{4}}(?![0-9]))"
)
_SIGNS = "".join(c for c in _BEGINS if not c.isalpha())
AMOUNT = (
    rf"[{''.join(c for c in _BEGINS if c.isalpha())}](?<![{_LETTERS}{_DIGITS}_.,].)(?=[a-z]*+(?: [a-z]++)?[$]? ?[0-9])(?<=(?<!\p{{L}})(?={CURRENCY} ?[0-9]).)[a-z]*+(?: [a-z]++)?[$]? ?{NUMBER}(?![0-9]){_AFTER}"
    rf"|[{_DIGITS}$£¥\u20a0-\u20bf](?<![{_LETTERS}{_DIGITS}_.,].)(?:(?<=[0-9])(?={_NUMBERS}*+ ?[{_BEGINS}])(?<=(?<!\p{{L}})(?={_NUMBERS}++ ?{CURRENCY})(?={NUMBER} ?[{_BEGINS}]).){_NUMBERS}*+ ?{CURRENCY}{_AFTER}"
    rf"|(?<=(?<!\p{{L}})[{_SIGNS}]) ?{NUMBER}(?![0-9]){_AFTER})"
)
PERCENT = rf"(?=[%y0-9])(?:% ?{NUMBER}(?![0-9])|(?=[0-9]){_BEFORE}(?={_NUMBERS}++ ?(?:%|per))(?:{NUMBER} ?%|{NUMBER} (?:percent|per cent){_AFTER})|(?=yu)(?<!\p{{L}})yuzde {NUMBER}(?![0-9]))"
PLAIN = rf"(?=[0-9])(?<![{_LETTERS}{_DIGITS}_.,/{{-])(?<!\p{{L}}){NUMBER}(?![.,/-]?[0-9])(?![\p{{L}}_}}])"
LABEL = rf"^(?=\s*+[0-9acsmACSM\u017f])(?:{structure.HEADED[1:]}|{structure.NUMBERED[1:]}|{structure.BARE[1:]})"
LANGUAGES = ("en", "tr", "az")
#: Two-cell rows that a bilingual table has at least, and their share of all rows. Fixed values.
ROWS, SHARE = 2, 0.6
SEVERITY = {"label": "high", "reference": "high", "date": "high", "amount": "high", "percent": "high", "number": "medium"}


def _number(compact: Column, last: Column, language: Column) -> Column:
    other, groups = F.when(last == ",", ".").otherwise(","), F.when(language == "en", ",").otherwise(".")
    several = F.length(compact) - F.length(F.replace(compact, last, F.lit(""))) > 1
    grouping = ~F.contains(compact, other) & (several | ((last == groups) & compact.rlike("[.,][0-9]{3}$")))
    plain = F.when(last == "", compact).when(grouping, F.replace(compact, last, F.lit(""))).otherwise(F.replace(F.replace(compact, other, F.lit("")), last, F.lit(".")))
    return plain.try_cast("decimal(38,10)")


def _compact(text: Column) -> Column:
    return F.translate(text, "\u00a0\u202f", "")


def _last(compact: Column) -> Column:
    return F.regexp_extract(compact, "([.,])[0-9]*$", 1)


def number(text: Column, language: Column) -> Column:
    """A number as a decimal: of two kinds of separators the last one is the decimal mark; one that stands several times, or before
    three digits where the language groups by it (English by commas, others by points), groups. Beyond 28 digits: null."""
    return let(_compact(text), lambda compact: let(_last(compact), lambda last: _number(compact, last, language)))


def _shown(value: Column) -> Column:
    """A decimal as text, which always has a point, without what says nothing."""
    return F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit("."))


#: What begins and ends a mark, and what stands for these where a text has them: no pattern takes any of the three.
OPEN, SHUT, OTHER = "\ue000", "\ue001", "\ue002"
_PASSED = f"{OPEN}[^{SHUT}]*+{SHUT}++"
#: The first character of a mark, by what it holds, in the order of turns; labels and references are `r`.
KINDS = {"d": "date", "a": "amount", "p": "percent", "n": "number"}


def marked(text: Column) -> Column:
    """The folded text with all that is taken in marks: OPEN, the kind, what is taken, SHUT. What one turn takes the next ones pass
    over, and put in a mark of their own: the innermost one counts."""
    own = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT)), F.translate(text, OPEN + SHUT, OTHER * 2)).otherwise(text)
    # a label is taken where no reference begins with it; else that takes all of the label
    named = F.regexp_replace(own, rf"{structure.REFERENCE}|^(?!\s*+(?:{structure.REFERENCE})){LABEL}", f"{OPEN}r$0{SHUT}")
    # as ascii_lower, for which it is enough to fold letters before they are made small: I and İ are both i then
    out = F.lower(F.translate(named, MARKED, FOLDED))
    for kind, pattern in zip(KINDS, (DATE, AMOUNT, PERCENT, PLAIN)):
        out = F.regexp_replace(out, f"{_PASSED}|{pattern}", f"{OPEN}{kind}$0{SHUT}")
    return out


def _cardinal(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[0-9])(?:st|nd|rd|th)", "")


def _date(text: Column) -> Column:
    return let(_cardinal(text), lambda t: audit.folded_date(t).cast("string"))


def figures(text: Column, language: Column) -> Column:
    """array<struct<kind, value, start, end>> of a text's figures: `date` (yyyy-mm-dd), `amount` (number and code), `percent` and
    `number`, each kind in order of place. Its own label and references are no figures; what cannot be read is none, but is taken.
    Null for null."""
    plain = lambda t: _shown(number(F.regexp_extract(t, f"({NUMBER})", 1), language))
    values = {"d": _date, "a": lambda t: F.concat(plain(t), F.lit(" "), _code(t)), "p": plain, "n": plain}
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,text:string,start:int,end:int>>").alias("out"))

    # a piece is a kind, then another mark, or what is taken, as many SHUTs as there are marks, and what follows them
    def step(acc: Column, x: Column) -> Column:
        taken, size = F.substring_index(x, SHUT, 1), F.length(F.replace(x, F.lit(SHUT), F.lit(""))) - 1
        span = F.struct(F.substring(taken, 1, 1).alias("kind"), F.substring(taken, F.lit(2), F.length(taken)).alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(taken) - 1).alias("end"))
        return F.struct((acc["at"] + size).alias("at"), F.when(F.contains(x, F.lit(SHUT)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def read(spans: Column) -> Column:
        of = lambda k: F.transform(F.filter(spans, lambda s: s["kind"] == k), lambda s: F.struct(F.lit(KINDS[k]).alias("kind"), values[k](s["text"]).alias("value"), s["start"], s["end"]))
        return F.concat(*map(of, KINDS))

    none = F.array().cast("array<struct<kind:string,value:string,start:int,end:int>>")
    found = F.aggregate(F.split(F.concat(F.lit("r"), marked(text)), OPEN, -1), begin, step, lambda acc: acc["out"])
    return F.when(text.rlike("[0-9]"), F.filter(let(found, read), lambda x: x["value"].isNotNull())).when(text.isNotNull(), none)


def read(rows: DataFrame, text: Column, language: Column, keys: list[str]) -> DataFrame:
    """(keys, kind, value): the figures of texts as rows, without their places. A text's marks are read in one pass, and each figure
    by plain columns, so that all of it is compiled: an expression within a function of arrays is not."""
    tokens = F.when(text.rlike("[0-9]"), F.regexp_extract_all(marked(text), F.lit(f"{OPEN}([{''.join(KINDS)}][^{OPEN}{SHUT}]+){SHUT}"), F.lit(1)))
    # outer, as Catalyst would look at an inner one's array once more to filter by its size
    out = rows.select(*keys, language.alias("__language"), F.explode_outer(tokens).alias("__token")).where("__token is not null")
    # step by step: what is read twice is made once. Behind a generator a new method begins: one of all steps has more than the 8,000
    # bytes up to which the JVM compiles, and runs half as fast
    kind, text, compact = F.col("__kind"), F.col("__text"), F.col("__compact")
    out = out.select(*keys, "__language", F.substring("__token", 1, 1).alias("__kind"), F.expr("substring(__token, 2)").alias("__text"))
    out = out.select(*keys, "__language", "__kind", F.when(kind == "d", _cardinal(text)).otherwise(text).alias("__text"), F.when(kind != "d", _compact(F.regexp_extract(text, NUMBER, 0))).alias("__compact"))
    out = out.select(*keys, "__language", "__kind", "__text", "__compact", _last(compact).alias("__last"))
    out = out.select(*keys, "__kind", "__text", F.explode_outer(F.array(_number(compact, F.col("__last"), F.col("__language")))).alias("__number"))
    out = out.select(*keys, "__kind", "__text", _shown(F.col("__number")).alias("__shown"))
    out = out.select(*keys, "__kind", "__shown", F.when(kind == "d", audit.folded_date(text).cast("string")).when(kind == "a", F.concat(F.lit(" "), _code(text))).otherwise("").alias("__rest"))
    value = F.when(kind == "d", F.col("__rest")).otherwise(F.concat("__shown", "__rest"))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), kind)
    # a filter on a generator's rows is not moved below it, where the value would be computed for it once more
    out = out.select(*keys, F.explode_outer(F.array(F.struct(name.alias("kind"), value.alias("value")))).alias("__figure"))
    return out.where("__figure.value is not null").select(*keys, "__figure.kind", "__figure.value")


def _code(text: Column) -> Column:
    """The code of the currency that an amount names."""
    codes = F.create_map(*(F.lit(v) for pair in _WORDS.items() for v in pair))
    return F.try_element_at(codes, F.regexp_extract(text, f"(?=[{_BEGINS}]){_by_first(_ESCAPED)}", 0))


def table_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, columns, left, right) of cells (doc_id, table_id, row, col, p_idx, text), several paragraphs a cell:
    columns are those with text, in order; left and right are the paragraphs of the first and of the last of them."""
    own = cells.where(F.trim("text") != "").groupBy("doc_id", "table_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "p_idx", "text"))).alias("__p"))
    side = lambda c: F.transform(F.filter("__p", lambda p: p["col"] == c), lambda p: F.struct(p["p_idx"], p["text"]))
    first, last = F.col("__p")[0]["col"], F.element_at("__p", -1)["col"]
    return own.select("doc_id", "table_id", "row", F.array_distinct(F.transform("__p", lambda p: p["col"])).alias("columns"), side(first).alias("left"), side(last).alias("right"))


def counted(rows: DataFrame) -> DataFrame:
    """rows (of `table_rows`) with left_words and right_words: the words of LANGUAGES on either side, of rows of two cells."""
    text = lambda c: F.array_join(F.transform(c, lambda p: p["text"]), " ")
    return rows.withColumns({f"{s}_words": F.when(F.size("columns") == 2, audit.language_counts(text(s), LANGUAGES)) for s in ("left", "right")})


def bilingual_tables(rows: DataFrame) -> DataFrame:
    """(doc_id, table_id, left_language, right_language): tables (of `counted` rows) with at least ROWS rows of two cells with text,
    which are SHARE of all rows with text or more and lie in the same two columns, written in two languages of LANGUAGES. Words are
    counted row by row and summed up; no column's text is put together."""
    pair = F.size("columns") == 2
    each = rows.select("doc_id", "table_id", pair.alias("pair"), *(F.when(pair, F.get("columns", F.lit(k))).alias(c) for k, c in enumerate("ab")), *(F.col(f"{s}_words").alias(s) for s in ("left", "right")))
    sums = [F.sum(F.col(s)[n]).alias(f"{s}_{n}") for s in ("left", "right") for n in ("total", "marked", *LANGUAGES)]
    per = each.groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("pair").alias("pairs"), *((F.min(c) == F.max(c)).alias(c) for c in "ab"), *sums)
    fits = per.where((F.col("pairs") >= ROWS) & (F.col("pairs") >= SHARE * F.col("n")) & F.col("a") & F.col("b"))
    told = lambda s: audit.language_of(F.struct(*(F.col(f"{s}_{n}").alias(n) for n in ("total", "marked", *LANGUAGES))), LANGUAGES)
    return fits.select("doc_id", "table_id", told("left").alias("left_language"), told("right").alias("right_language")).where("left_language <> right_language")


def _label(text: Column) -> Column:
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(part(structure.HEADED), part(structure.NUMBERED), part(structure.BARE))


def bilingual_findings(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, kind, severity, only_left, only_right): what only one side of a row of a bilingual table has, counted
    as often as it stands there, in order: kinds are those of SEVERITY. Labels differ only where both sides have one, and plain
    numbers only where both sides have one that the other lacks, as one side may spell a number out."""
    # texts are put together and counted once: what tells a table's languages reads the counts alone
    rows = kept(counted(table_rows(cells)), "rows")
    own = kept(rows.where(F.size("columns") == 2).join(bilingual_tables(rows), ["doc_id", "table_id"]).drop("columns", "left_words", "right_words"), "bilingual")
    side = lambda s: F.transform(s, lambda p: F.struct(F.lit(s).alias("side"), F.col(f"{s}_language").alias("language"), p["p_idx"].alias("p_idx"), p["text"].alias("text")))
    place = ["doc_id", "table_id", "row"]
    each = own.select(*place, F.inline(F.concat(side("left"), side("right"))))
    found = read(each, F.col("text"), F.col("language"), [*place, "side"])
    # references are read for each paragraph as those of one document
    asked = structure.references(each.select(F.struct(*place, "side").alias("doc_id"), "p_idx", "text")).select("doc_id.*", F.lit("reference").alias("kind"), F.concat("part", "below").alias("value"))
    get = lambda s: F.try_element_at(F.filter(F.transform(s, lambda p: _label(p["text"])), lambda v: v.isNotNull()), F.lit(1))
    labels = own.select(*place, F.array(F.struct(F.lit("left").alias("side"), get("left").alias("value")), F.struct(F.lit("right").alias("side"), get("right").alias("value"))).alias("l"))
    labels = labels.where(F.forall("l", lambda x: x["value"].isNotNull())).select(*place, F.inline("l")).select(*place, "side", F.lit("label").alias("kind"), "value")
    every = reduce(DataFrame.unionByName, [found, asked, labels])
    counts = every.groupBy(*place, "kind", "value").agg((F.count_if(F.col("side") == "left") - F.count_if(F.col("side") == "right")).alias("more")).where("more <> 0")
    only = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("value"))))
    out = counts.groupBy(*place, "kind").agg(only(F.col("more") > 0).alias("only_left"), only(F.col("more") < 0).alias("only_right"))
    severity = reduce(lambda w, k: w.when(F.col("kind") == k, SEVERITY[k]), SEVERITY, F.when(F.lit(False), ""))
    return out.where("kind <> 'number' or size(only_left) > 0 and size(only_right) > 0").select(*place, "kind", severity.alias("severity"), "only_left", "only_right")
