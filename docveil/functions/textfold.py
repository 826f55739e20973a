"""Text folding for Turkish and Azerbaijani: case, diacritics and keys, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to. Fixed values.
MARKED, PLAIN = "çğıöşüâîûəÇĞİÖŞÜÂÎÛƏ", "cgiosuaiueCGIOSUAIUE"


def tr_lower(text: Column) -> Column:
    """Lower case with I to ı and İ to i; never changes the length of Turkish text."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


def tr_upper(text: Column) -> Column:
    """Upper case with i to İ and ı to I."""
    return F.upper(F.translate(text, "iı", "İI"))


def ascii_fold(text: Column) -> Column:
    """Without diacritics and in upper case: how labels are compared."""
    return F.upper(F.translate(text, MARKED, PLAIN))


def ascii_lower(text: Column) -> Column:
    return F.translate(tr_lower(text), MARKED, PLAIN)


def key(text: Column) -> Column:
    """The vault's key: lower case and single spaces."""
    return F.trim(F.regexp_replace(tr_lower(text), r"[ \t\r\n\x0B\f]+", " "))


#: Legal forms at the end of a company's name, folded, longest first.
LEGAL_FORMS = [
    "anonim sirketi", "limited sirketi", "kollektif sirketi", "komandit sirketi", "ltd. sti.", "ltd sti", "ltd.sti.", "a.s.", "a.s", "as",
    "limited", "gmbh", "ltd.", "ltd", "llc", "inc.", "inc", "plc", "corp.", "corp", "s.a.", "b.v.", "s.r.l.", "ag",
]


def company_core(text: Column) -> Column:
    """A company's folded name without its legal form."""
    forms = "|".join(f.replace(".", "[.]").replace(" ", " ?") for f in LEGAL_FORMS)
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(text), r"[ \t\r\n]+", " "), f"[ ,]+({forms})[ ,.]*$", ""))


#: Types of which letters and digits alone count.
NUMBERS = ("TCKN", "VKN", "IBAN", "TELEFON", "KART", "PLAKA", "MERSIS", "PASAPORT", "SICIL_NO")


def canonical(label_type: Column, text: Column) -> Column:
    """What makes two findings the same value: letters and digits of numbers, the core of companies, else the key."""
    return F.when(label_type.isin(*NUMBERS), F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")).when(label_type == "SIRKET", company_core(text)).otherwise(key(text))
