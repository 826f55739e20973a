"""Matches with offsets: the kernel under all detection.

Between matches lie what a split leaves, so a fold over both gives each match's place in code points, row by row and without
a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"


def _placed(text: Column, pattern: str | Column, found: Column) -> Column:
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.length(x["m"])
        span = F.struct(first.alias("start"), last.alias("end"), x["m"].alias("text"))
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    folded = F.aggregate(both, empty, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, folded).otherwise(F.array().cast(f"array<{SPAN}>"))


#: Stands on both sides of a match while its place is found. A text that has it is searched and split instead.
MARK = "\ue000"


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, text>> of all matches, left to right, in code points. The pattern matches no empty text.

    Matches are marked in one pass and the text is split at the marks: a split at a pattern would compile it for every text.
    """
    if not isinstance(pattern, str):
        return _placed(text, pattern, F.regexp_extract_all(text, pattern, F.lit(0)))
    empty = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["at"] + F.length(x)
        span = F.struct(acc["at"].alias("start"), last.alias("end"), x.alias("text"))
        return F.struct(last.alias("at"), (~acc["match"]).alias("match"), F.when(acc["match"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    marked = F.aggregate(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1), empty, step, lambda acc: acc["out"])
    split = _placed(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(F.contains(text, F.lit(MARK)), split).otherwise(F.coalesce(marked, F.array().cast(f"array<{SPAN}>")))


def literal(text: str) -> str:
    """text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str) -> str:
    """`spans` of a column and a pattern as SQL text. What has many patterns is built much faster of text than of columns."""
    p, none = literal(pattern), f"CAST(array() AS array<{SPAN}>)"
    found = f"regexp_extract_all({text}, {p}, 0)"
    both = f"zip_with({found}, slice(split({text}, {p}, -1), 1, size({found})), (m, g) -> struct(m AS m, length(g) AS gap))"
    span = "struct(acc.at + x.gap AS start, acc.at + x.gap + length(x.m) AS end, x.m AS text)"
    step = f"(acc, x) -> struct(acc.at + x.gap + length(x.m) AS at, concat(acc.out, array({span})) AS out)"
    split = f"aggregate({both}, struct(0 AS at, {none} AS out), {step}, acc -> acc.out)"
    span = "struct(acc.at AS start, acc.at + length(x) AS end, x AS text)"
    step = f"(acc, x) -> struct(acc.at + length(x) AS at, NOT acc.match AS match, CASE WHEN acc.match THEN concat(acc.out, array({span})) ELSE acc.out END AS out)"
    marked = f"aggregate(split(regexp_replace({text}, {p}, '{MARK}$0{MARK}'), '{MARK}', -1), struct(0 AS at, false AS match, {none} AS out), {step}, acc -> acc.out)"
    return f"CASE WHEN contains({text}, '{MARK}') THEN {split} ELSE {marked} END"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, also where body uses it for each of many things."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_number(text: Column, start: Column) -> Column:
    """The line, from 1, on which a place lies."""
    return F.size(F.split(F.substring(text, F.lit(1), start), "\n"))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def splice(text: Column, edits: Column) -> Column:
    """text with edits array<struct<start, end, replacement>> applied; null where edits overlap."""
    ordered = F.array_sort(edits, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, e: Column) -> Column:
        # by column functions: lengths and starts are columns here
        kept = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], kept, e["replacement"]).alias("out"), (acc["ok"] & (e["start"] >= acc["at"])).alias("ok"))

    return F.aggregate(ordered, begin, step, lambda acc: F.when(acc["ok"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
