"""How list numbers are written, and versions compared, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits of ones, tens and hundreds. Fixed values.
ROMAN = ("i", "v", "x"), ("x", "l", "c"), ("c", "d", "m")


def roman(n: Column) -> Column:
    """n in lower-case Roman letters, thousands as a run of m; below 1: 0."""
    shapes = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    digit = lambda k: F.get(F.array(*map(F.lit, shapes(*ROMAN[k]))), (F.floor(n / 10**k) % 10).cast("int"))
    return F.when(n > 0, F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(2), digit(1), digit(0))).otherwise("0")


def letters(n: Column) -> Column:
    """a to z, then aa to zz, then aaa; below 1: 0."""
    return F.when(n > 0, F.repeat(F.char(97 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("0")


def formatted(n: Column, form: Column) -> Column:
    """n as a list shows it: decimal, decimalZero (two digits at least), lower and upper letters and Roman; others: decimal."""
    text = n.cast("string")
    return (
        F.when(form == "lowerRoman", roman(n)).when(form == "upperRoman", F.upper(roman(n)))
        .when(form == "lowerLetter", letters(n)).when(form == "upperLetter", F.upper(letters(n)))
        .when((form == "decimalZero") & n.between(0, 9), F.lpad(text, 2, "0")).otherwise(text)
    )


def version(text: Column) -> Column:
    """A dotted version as array<int>, which compares as versions do; null for what is none."""
    return F.when(F.trim(text).rlike("^[0-9]{1,9}(?:[.][0-9]{1,9})*$"), F.split(F.trim(text), "[.]").cast("array<int>"))


def folder_name(text: Column, most: int = 80) -> Column:
    """text as a folder's name: without characters that paths can't have, single spaces, at most `most` characters; `untitled`
    where nothing is left."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\x00-\x1f<>:"/\\|?*]', " ")), "[.]+$", "")
    name = F.substring(F.trim(F.regexp_replace(clean, r"\s+", " ")), 1, most)
    return F.when(name == "", "untitled").otherwise(name)
