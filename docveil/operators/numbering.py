"""Automatic numbers of list paragraphs: counters that restart below a level that moves on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions.numerals import formatted

DEPTH = 9


def auto_numbers(rows: DataFrame, levels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """rows (doc_id, list_id, p_idx, level from 0) with `label`, as levels (list_id, level, start, form, shown) write it, `shown`
    being like `%1.%2)`. A level that was not counted yet shows its start; a level that levels do not have, or whose form is
    `bullet`, has no label. levels is a table of styles, which holds at most `depth` rows a list.

    One window over a list: a level's count less what it was where a higher level last moved on.
    """
    order = Window.partitionBy("doc_id", "list_id").orderBy("p_idx")
    n = [f"__n{k}" for k in range(depth)]
    own = F.col("level")
    out = rows.withColumns({c: F.sum((own == k).cast("int")).over(order) for k, c in enumerate(n)})
    out = out.withColumns({f"__b{k}": F.coalesce(F.max(F.when(own < k, F.col(c))).over(order), F.lit(0)) for k, c in enumerate(n)})
    styles = levels.groupBy("list_id").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("start", "form", "shown")))).alias("__styles"))
    out = out.join(styles, "list_id", "left")
    style = lambda k: F.try_element_at("__styles", k)
    label = style(own)["shown"]
    for k, c in enumerate(n):
        s = style(F.lit(k))
        count = F.greatest(F.col(c) - F.col(f"__b{k}"), F.lit(1)) - 1 + F.coalesce(s["start"], F.lit(1))
        label = F.replace(label, F.lit(f"%{k + 1}"), F.coalesce(formatted(count, F.coalesce(s["form"], F.lit("decimal"))), F.lit("")))
    return out.select(*(rows[c] for c in rows.columns), F.when(style(own)["form"] != "bullet", label).alias("label"))
