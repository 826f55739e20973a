"""Long texts in parts, and items in pages: greedy cuts that keep protected spans whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 30_000


def cuts(text: str, size: int, protected: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of at most `size` characters: cut after a line end, else a space, in a part's second half, never inside a
    protected span. A span that starts with its part and is longer than it stays whole."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for mark in ("\n", " "):
                k = text.rfind(mark, at + size // 2, end)
                if k >= 0:
                    end = k + 1
                    break
            for a, b in sorted(protected, reverse=True):
                if a < end < b:
                    end = a if a > at else b
        out.append((at, end))
        at = end
    return out or [(0, 0)]


def parts(docs: DataFrame, size: int = PART, text: str = "text", protected: str | None = None) -> DataFrame:
    """(doc_id, part, start, end) of every document; `protected` names an array<struct<start, end, ...>>."""
    spans = F.transform(protected, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) if protected else F.array().cast("array<struct<start:int,end:int>>")
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), spans.alias("spans"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(d, i + 1, a, b) for d, t, s in zip(f["doc_id"], f["text"], f["spans"]) for i, (a, b) in enumerate(cuts(t, size, [(x["start"], x["end"]) for x in s]))]
            yield pd.DataFrame(out, columns=["doc_id", "part", "start", "end"])

    return rows.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, start int, end int")


def paginate(items: DataFrame, size: int, group: str, order: str, length: str) -> DataFrame:
    """items with `page` from 1: in order, as many of a group as fit into `size`; an item longer than that has its own page.

    A group's running state is its page and how full it is, folded over (order, length) pairs only.
    """
    pairs = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("long").alias("n")))).alias("p"))
    start = F.struct(F.lit(1).alias("page"), F.lit(0).cast("long").alias("full"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        new = (acc["full"] > 0) & (acc["full"] + x["n"] > size)
        page = F.when(new, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(page.alias("page"), F.when(new, x["n"]).otherwise(acc["full"] + x["n"]).alias("full"), F.concat(acc["out"], F.array(page)).alias("out"))

    paged = pairs.select(group, F.inline(F.arrays_zip(F.col("p.o").alias(order), F.aggregate("p", start, step, lambda a: a["out"]).alias("page"))))
    return items.join(paged, [group, order])
