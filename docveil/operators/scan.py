"""Scans of whole texts: red lines (what must not go out even masked), residual values, reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.operators.match import SPAN, line_number, spans
from docveil.operators.rules import RULES
from docveil.operators.vault import LABEL

#: What a text may say of a matter that must not go out, by what the law protects: the lawyer's secret (advice and conduct of a
#: case), talks to settle, trade secrets, the special categories of personal data, information that moves a price, and files
#: on staff. Cues in English, then in Turkish; a space stands for spaces or a hyphen.
CUES = {
    "defence_strategy": (
        "attorney client, client privilege, counsel's advice, defence strategy, defense strategy, legal advice privilege, legal privilege, legally privileged, litigation privilege, litigation strategy, privileged and confidential, trial strategy, work product",
        "avukat müvekkil, avukatlık sırrı, dava stratejisi, müvekkil sırrı, savunma hazırlığı, savunma planı, savunma stratejisi, vekalet gizliliği",
    ),
    "settlement": (
        "batna, bottom line, settlement amount, settlement authority, settlement limit, settlement offer, settlement proposal, settlement talks, walk away, without prejudice",
        "arabuluculuk teklifi, sulh görüşme, sulh sınırı, sulh teklifi, uzlaşma görüşme, uzlaşma teklifi",
    ),
    "trade_secret": (
        "commercially sensitive, company confidential, confidentiality agreement, know how, non disclosure, proprietary information, source code, strictly confidential, trade secret",
        "gizlidir, gizlilik sözleşmesi, sınai sır, ticari sır, üretim sırrı",
    ),
    "special_category": (
        "biometric, criminal conviction, criminal record, diagnosed, diagnosis, ethnic origin, genetic data, health data, hiv, medical history, medical record, political opinion, religious belief, sex life, sexual orientation, trade union",
        "biyometrik, ceza mahkumiyet, cinsel hayat, cinsel yönelim, dini inanç, etnik köken, felsefi inanç, genetik veri, mahkumiyet, sabıka kaydı, sağlık raporu, sağlık verisi, sendika üye, siyasi düşünce, teşhis, ırk bilgisi",
    ),
    "inside_information": (
        "inside information, insider, letter of intent, price sensitive, term sheet, undisclosed acquisition, undisclosed merger",
        "birleşme görüşme, devralma görüşme, içeriden öğrenen, içsel bilgi, niyet mektubu",
    ),
    "personnel_file": (
        "disciplinary action, disciplinary file, disciplinary record, payroll, payslip, performance appraisal, performance review, personnel file, salary slip",
        "disiplin cezası, disiplin soruşturması, maaş bordrosu, performans değerlendirme, sicil amiri, özlük dosyası",
    ),
}
#: Letters that have their other case outside of ASCII, or more than one.
CASES = {c: "[" + "".join(dict.fromkeys(c + d)) + "]" for c, d in {"ç": "Ç", "ğ": "Ğ", "ı": "Iiİ", "i": "İıI", "ö": "Ö", "ş": "Ş", "ü": "Ü"}.items()}


def cue_pattern(cues: str) -> str:
    """A pattern of cues in any case, the longest first."""
    ordered = sorted((c.strip() for c in cues.split(",")), key=lambda c: (-len(c), c))
    write = lambda c: "".join("[ \\t-]+" if x == " " else CASES.get(x, x) for x in c)
    # by first letters, so that most places of a text are passed by with one look at each letter
    by_first: dict[str, list[str]] = {}
    for c in ordered:
        by_first.setdefault(c[0].replace("ı", "i"), []).append(c)
    groups = [f"{CASES.get(first, first)}(?:{'|'.join(write(c[1:]) for c in of)})" for first, of in sorted(by_first.items())]
    return "(?i)(" + "|".join(groups) + ")"


def told_by(cues: str) -> list[str]:
    """The longest word of each cue, as `plain` writes it: a text without any of them has none of the cues."""
    return sorted({max(c.replace("ı", "i").split(), key=len) for c in cues.split(",")})


def plain(text: Column) -> Column:
    return F.lower(F.translate(text, "İIı", "iii"))


RED_LINES = [(category, cue_pattern(", ".join(both))) for category, both in CUES.items()]


def _number(length: int, first: str = "0-9", before: str = "0-9", after: str = "") -> str:
    """A number of so many digits: its first digit, what may not be right before it, and marks that may not lead on to more."""
    return f"(?<![{before}])[{first}][0-9]{{{length - 1}}}(?!{f'[0-9{after}][0-9]' if after else '[0-9]'})"


_WORD = "A-Za-z0-9_"
#: (kind, pattern) of what may have been missed in a masked text, from how the numbers are made up: an identity number has 11
#: digits and no zero in front; a tax number has 10, and a number of 11 counts as one, too; an account number is the country,
#: two check digits and groups of four, of which two tell it; a mobile number begins with the country or a zero, then 5.
RESIDUALS = [
    ("11 digits", _number(11, first="1-9")),
    ("10 digits", _number(10, before="0-9/.,", after="/.,")),
    ("iban", f"(?<![{_WORD}])TR ?[0-9]{{2}}" + "(?: ?[0-9]{4})" + "{2,}"),
    ("e-mail", next(r.pattern for r in RULES if r.name == "email")),
    ("mobile", f"(?:[+]90|(?<![{_WORD}])0) ?5[0-9]{{2}}"),
]
RESIDUAL_SCORE = 45


def hits(docs: DataFrame, cues: list[tuple[str, str]], text: str = "text", words: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, category, start, end, line, sample): every match of every cue, in one scan. Places are worked out only where
    there is a cue; with `words` of a category, only of texts that have one of them."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(category: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(category).alias("category"), s["start"], s["end"], s["text"].alias("sample"))

    def may(category: str, pattern: str) -> Column:
        if words is None:
            return F.col("__text").rlike(pattern)
        return reduce(Column.__or__, (F.contains("__plain", F.lit(w)) for w in words[category]))

    rows = docs.select("doc_id", F.col(text).alias("__text"))
    if words is not None:
        rows = rows.withColumn("__plain", plain(F.col("__text")))
    found = F.concat(*(F.transform(F.when(may(c, p), spans(F.col("__text"), p)).otherwise(none), of(c)) for c, p in cues))
    return rows.select("doc_id", "__text", F.inline(found)).withColumn("line", line_number(F.col("__text"), F.col("start"))).drop("__text")


def red_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, category, lines, sample): the lines of each category's cues, and its first cue."""
    words = {category: told_by(", ".join(both)) for category, both in CUES.items()}
    return hits(docs, RED_LINES, text, words).groupBy("doc_id", "category").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.min_by("sample", F.struct("start", "end", "sample")).alias("sample"))


def residual(docs: DataFrame, text: str = "masked") -> DataFrame:
    """(doc_id, category, line, n) of what a masked text still shows. Labels do not count."""
    blank = docs.select("doc_id", F.regexp_replace(text, LABEL, " ").alias("text"))
    return hits(blank, RESIDUALS).groupBy("doc_id", "category", "line").agg(F.count(F.lit(1)).alias("n"))


def report(findings: DataFrame) -> DataFrame:
    """(label_type, n_findings, n_values, n_docs)."""
    return findings.groupBy("label_type").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("canonical").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"))


def status(red: Column, waiting: Column) -> Column:
    """red-line before needs-approval before ready."""
    return F.when(red, "red-line").when(waiting, "needs-approval").otherwise("ready")
