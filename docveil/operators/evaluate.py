"""Quality of detection against labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.operators.match import let

GOLD = r"\{\{[A-Z_]+\|[^{}]*\}\}"


def gold(lines: DataFrame, text: str = "text") -> DataFrame:
    """(line_id, plain, spans array<struct<start, end, label_type>>) of inline labels `{{TYPE|value}}`; lines that start with
    # are left out."""
    from docveil.operators.match import spans

    marked = lines.where(~F.startswith(text, F.lit("#")))
    found = spans(F.col(text), GOLD)
    kind = lambda s: F.regexp_extract(s["text"], r"^\{\{([A-Z_]+)\|", 1)
    value = lambda s: F.regexp_extract(s["text"], r"\|([^{}]*)\}\}$", 1)
    begin = F.struct(F.lit(0).alias("gone"), F.array().cast("array<struct<start:int,end:int,label_type:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        first = s["start"] - acc["gone"]
        size = F.length(value(s))
        return F.struct((acc["gone"] + s["end"] - s["start"] - size).alias("gone"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), (first + size).alias("end"), kind(s).alias("label_type")))).alias("out"))

    return marked.select("line_id", F.regexp_replace(text, r"\{\{[A-Z_]+\|([^{}]*)\}\}", "$1").alias("plain"), F.aggregate(found, begin, step, lambda a: a["out"]).alias("spans"))


def scores(rows: DataFrame) -> DataFrame:
    """(label_type, gold, leaked, found, right) over rows with `spans` (gold) and `kept` (findings): leaked gold spans are
    overlapped by nothing kept; right findings overlap gold of their type."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    side = lambda x, gold, hit: F.struct(x["label_type"].alias("label_type"), F.lit(gold).alias("gold"), hit.alias("hit"))
    both = F.struct(F.coalesce("spans", F.array()).alias("spans"), F.coalesce("kept", F.array()).alias("kept"))
    judged = lambda b: F.concat(
        F.transform(b["spans"], lambda s: side(s, True, F.exists(b["kept"], lambda k: meets(s, k)))),
        F.transform(b["kept"], lambda k: side(k, False, F.exists(b["spans"], lambda s: meets(s, k) & (s["label_type"] == k["label_type"])))),
    )
    # both sides in one pass, and outer: an inner one asks for the size of the array first, which computes it twice
    each = rows.select(F.explode_outer(let(both, judged)).alias("x")).select("x.*").where("gold is not null")
    counts = {"gold": "gold", "leaked": "gold and not hit", "found": "not gold", "right": "not gold and hit"}
    return each.groupBy("label_type").agg(*(F.count_if(F.expr(e)).alias(n) for n, e in counts.items()))
