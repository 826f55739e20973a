"""Check digits of identifiers, by their public definitions, as native column expressions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(text: Column, place: int) -> Column:
    """The digit at a place counted from 1."""
    return F.substring(text, place, 1).cast("int")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text, 12 to 19 of them, have a valid Luhn check digit."""
    d = digits(text)
    return F.length(d).between(12, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def national_id(text: Column) -> Column:
    """Turkish national id: 11 digits, the first not 0, the tenth from the odd and even places, the last from the sum."""
    d = [digit(text, i) for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == d[9]
    last = F.pmod(odd + even + d[9], F.lit(10)) == d[10]
    return F.coalesce(F.when(text.rlike("^[1-9][0-9]{10}$"), tenth & last).otherwise(F.lit(False)), F.lit(False))


def tax_id(text: Column) -> Column:
    """Turkish tax id: 10 digits, each of the first nine moved by its place, doubled that often modulo 9 (9 for 0)."""
    total = F.lit(0)
    for i in range(9):
        moved = F.pmod(digit(text, i + 1) + (9 - i), F.lit(10))
        part = F.pmod(moved * (2 ** (9 - i)), F.lit(9))
        total = total + F.when((moved != 0) & (part == 0), 9).otherwise(part)
    check = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))
    return F.coalesce(F.when(text.rlike("^[0-9]{10}$"), check == digit(text, 10)).otherwise(F.lit(False)), F.lit(False))


def iban(text: Column) -> Column:
    """ISO 13616: country and check digits moved to the end, letters as 10 to 35, the rest modulo 97 is 1; 26 long for TR."""
    compact = F.upper(F.regexp_replace(text, "[ ]", ""))
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    characters = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(characters, F.lit(0), lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))
    shape = compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (~compact.startswith("TR") | (F.length(compact) == 26))
    return F.coalesce(F.when(shape, rest == 1).otherwise(F.lit(False)), F.lit(False))
