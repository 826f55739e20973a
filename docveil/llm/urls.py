"""URL filter by a path-template tree, in DataFrame operations only.

Below each host, path segments that few pages have become wildcards; the others stay literal, and siblings whose labels and
next segments do not differ statistically are merged. The tree goes down as long as a node has pages enough to split. A
template is rejected if the smoothed share of blocked pages among its labelled ones is more than half. Rules for hosts and
paths label pages, and decide where they fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.common import discarded, staged, table
from docveil.llm.html import host

#: Pages that a segment needs to stay literal, and a node to be split.
LEAST = 8
#: Labelled pages from which on a segment's share of blocked pages is held against its siblings', the bound of that chi-squared
#: test (one degree of freedom, 5 %), and into how many steps shares are sorted, so that a node has few of them to compare.
LABELS = 10
CHI2 = 3.841
STEPS = 64
#: Weight of the corpus's share of blocked pages, in labelled pages, in a template's share.
PRIOR = 10

#: (host, path, verdict) of the query's rules. Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def path(url: str = "url") -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for a null url or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits the columns host and path, as struct<size, rule, verdict>; null if none does."""
    kind = "struct<size:int,rule:string,verdict:string>"
    fits = [
        F.when(
            ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    none = F.lit(None).cast(kind)
    return F.greatest(none, none, *fits)


def shape(segment: Column) -> Column:
    """0 no segment, 1 digits, 2 with a digit, 3 without."""
    return F.when(segment.isNull(), 0).when(segment.rlike("^[0-9]+$"), 1).when(segment.rlike("[0-9]"), 2).otherwise(3)


def templates(pages: DataFrame) -> DataFrame:
    """pages (with host, path and the labels `blocked`: 1, 0 or null) with `template`.

    One round a level, for the pages of nodes that may still split; what is below a node of fewer than LEAST pages is one
    last wildcard `**`. The rounds end with the deepest path that LEAST pages of a host share up to wildcards.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = staged(pages.withColumn("template", F.lit("")).withColumn("__rest", segments).withColumn("__open", F.size(segments) > 0), "pages")
    done = [rows.where("not __open")]
    while True:
        here = rows.where("__open").withColumn("__segment", F.get("__rest", F.lit(0))).withColumn("__shape", shape(F.get("__rest", F.lit(1))))
        children = staged(
            here.groupBy("host", "template", "__segment").agg(
                F.count(F.lit(1)).alias("n"),
                F.count("blocked").alias("m"),
                F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"),
                *(F.count_if(F.col("__shape") == k).alias(f"s{k}") for k in range(4)),
            ),
            "children",
        )
        names = staged(named(children.where(F.col("n") >= LEAST)), "names")
        name = F.concat("template", F.lit("/"), F.coalesce("__name", F.lit("*"))).alias("template")
        on = children.join(names, ["host", "template", "__segment"], "left").withColumn("__further", F.col("n") - F.col("s0"))
        nodes = on.groupBy("host", name).agg(F.sum("__further").alias("__further")).where(F.col("__further") >= LEAST)
        nodes = staged(nodes.select("host", "template", F.lit(True).alias("__splits")), "nodes")
        below = here.join(names, ["host", "template", "__segment"], "left").withColumn("template", name).withColumn("__rest", F.expr("slice(__rest, 2, size(__rest))"))
        below = below.join(nodes, ["host", "template"], "left").withColumn("__open", (F.size("__rest") > 0) & F.col("__splits").isNotNull())
        rows = staged(below.select(rows.columns), "pages")
        done.append(rows.where("not __open"))
        last = nodes.isEmpty()
        discarded(children, names, nodes)
        if last:
            break
    deeper = F.when(F.size("__rest") > 0, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return reduce(DataFrame.union, done).withColumn("template", deeper).drop("__rest", "__open")


def named(literal: DataFrame) -> DataFrame:
    """(host, template, __segment, __name) of literal segments: the name of the largest sibling of the same class.

    Next segments: whether the distribution of their shapes is within a fifth of all siblings', else the shape that is furthest
    above. Labels, among siblings alike in that: none; fewer than LABELS; else siblings are sorted by their share of blocked
    pages, in STEPS steps, and neighbouring steps are one class if their sums don't differ by a chi-squared test; half is always
    an edge. However many siblings there are, a node compares the sums of its steps only.
    """
    c = F.col
    sums = literal.groupBy("host", "template").agg(*(F.sum(k).alias(f"all_{k}") for k in ("n", "m", "b", "s0", "s1", "s2", "s3")))
    rows = literal.join(sums, ["host", "template"])
    above = [c(f"s{k}").cast("double") * c("all_n") - c(f"all_s{k}").cast("double") * c("n") for k in range(4)]
    near = reduce(lambda x, y: x + y, map(F.abs, above)) * 5 <= c("n").cast("double") * c("all_n") * 2
    most = reduce(lambda w, k: w.when(above[k] == F.greatest(*above), k + 1), range(1, 4), F.when(above[0] == F.greatest(*above), 1))
    step = F.when(c("m") >= LABELS, F.expr(f"b * {STEPS} div m") + F.when(c("b") * 2 > c("m"), 1).otherwise(0))
    rows = rows.select("host", "template", "__segment", "n", "m", "b", step.alias("__step"), F.when(near, 0).otherwise(most).alias("__shapes"))
    alike = ["host", "template", "__shapes"]
    in_order = Window.partitionBy(*alike).orderBy("__step")
    steps = rows.where("__step is not null").groupBy(*alike, "__step").agg(F.sum("m").alias("m2"), F.sum("b").alias("b2"))
    steps = steps.withColumn("m1", F.lag("m2").over(in_order)).withColumn("b1", F.lag("b2").over(in_order)).withColumn("__before", F.lag("__step").over(in_order))
    cross = c("b2").cast("double") * c("m1") - c("b1").cast("double") * c("m2")
    spread = c("m1").cast("double") * c("m2") * (c("b1") + c("b2")) * (c("m1") + c("m2") - c("b1") - c("b2"))
    half = (c("__before") <= STEPS // 2) & (c("__step") > STEPS // 2)
    edge = F.when(half | (cross * cross * (c("m1") + c("m2")) > CHI2 * spread), 1).otherwise(0)
    runs = steps.withColumn("__edge", edge).select(*alike, "__step", F.sum("__edge").over(in_order).alias("__run"))
    rows = rows.join(runs, [*alike, "__step"], "left").withColumn("__labels", F.when(c("m") == 0, -2).when(c("m") < LABELS, -1).otherwise(c("__run")))
    classes = ["host", "template", "__labels", "__shapes"]
    largest = rows.groupBy(*classes).agg(F.min_by("__segment", F.struct(-c("n"), c("__segment"))).alias("__name"))
    return rows.join(largest, classes).select("host", "template", "__segment", "__name")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every page (page_id, url); repeated rows are judged each.

    Pages on which a rule fits are the labelled ones. A template without labels has the corpus's share of blocked pages,
    at most a half, and is allowed.
    """
    rows = pages.select("page_id", host().alias("host"), path().alias("path")).withColumn("__rule", best_rule(rules))
    rows = rows.withColumn("blocked", F.when(F.col("__rule").isNotNull(), (F.col("__rule.verdict") == "block").cast("int")))
    rows = templates(rows)
    overall = rows.agg(F.count("blocked").alias("all_m"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("all_b"))
    sums = rows.groupBy("host", "template").agg(F.count("blocked").alias("m"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"))
    # (b + PRIOR * q) / (m + PRIOR) > 1/2, with q = (all_b + 1) / (all_m + 2) but at most 1/2, in whole numbers
    q_top, q_below = F.col("all_b") + 1, F.col("all_m") + 2
    above = F.col("b") * q_below * 2 + 2 * PRIOR * F.least(q_top, q_below / 2) > (F.col("m") + PRIOR) * q_below
    rejected = staged(sums.where("m > 0").join(F.broadcast(overall), how="inner").where(above).select("host", "template", F.lit(True).alias("__rejected")), "rejected")
    out = rows.join(rejected, ["host", "template"], "left")
    method = F.when(F.col("__rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", method).alias("verdict"), "template")


def op4(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB SQL of op4."""
    fits = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v, {i} AS i" for i, (h, p, v) in enumerate(RULES))
    shape_ = "CASE WHEN rest[2] IS NULL THEN 0 WHEN regexp_full_match(rest[2], '[0-9]+') THEN 1 WHEN regexp_matches(rest[2], '[0-9]') THEN 2 ELSE 3 END"
    counts = ", ".join(f"count(*) FILTER (WHERE shp = {k}) AS s{k}" for k in range(4))
    sums = ", ".join(f"sum({k})::BIGINT AS all_{k}" for k in ("n", "m", "b", "s0", "s1", "s2", "s3"))
    above = [f"(s{k}::DOUBLE * all_n - all_s{k}::DOUBLE * n)" for k in range(4)]
    most = " ".join(f"WHEN {x} = greatest({', '.join(above)}) THEN {k + 1}" for k, x in enumerate(above))
    level = f"""
            SELECT r.depth + 1, r.page_id, r.host, r.path, r.rule, r.rv, r.blocked, r.rest[2:], r.template || '/' || coalesce(x.nam, '*'),
                len(r.rest) > 1 AND o.host IS NOT NULL
            FROM tree r
            LEFT JOIN name x ON x.host = r.host AND x.template = r.template AND x.seg = r.rest[1]
            LEFT JOIN node o ON o.host = r.host AND o.template = r.template || '/' || coalesce(x.nam, '*')
            WHERE r.opened"""
    children = f"""child AS (SELECT host, template, rest[1] AS seg, count(*) AS n, count(blocked) AS m, coalesce(sum(blocked), 0)::BIGINT AS b, {counts}
                FROM (SELECT *, {shape_} AS shp FROM tree WHERE opened) GROUP BY ALL),
            lit AS (SELECT * FROM child WHERE n >= {LEAST}),
            total AS (SELECT host, template, {sums} FROM lit GROUP BY ALL),
            tested AS (SELECT *, CASE WHEN m >= {LABELS} THEN b * {STEPS} // m + (b * 2 > m)::INT END AS step,
                CASE WHEN ({" + ".join(f"abs({x})" for x in above)}) * 5 <= n::DOUBLE * all_n * 2 THEN 0 {most} END AS shps FROM lit JOIN total USING (host, template)),
            stepped AS (SELECT host, template, shps, step, sum(m)::BIGINT AS m2, sum(b)::BIGINT AS b2 FROM tested WHERE step IS NOT NULL GROUP BY ALL),
            beside AS (SELECT *, lag(m2) OVER w AS m1, lag(b2) OVER w AS b1, lag(step) OVER w AS st1 FROM stepped WINDOW w AS (PARTITION BY host, template, shps ORDER BY step)),
            crossed AS (SELECT *, b2::DOUBLE * m1 - b1::DOUBLE * m2 AS crs, m1::DOUBLE * m2 * (b1 + b2) * (m1 + m2 - b1 - b2) AS spread FROM beside),
            edged AS (SELECT *, CASE WHEN st1 <= {STEPS // 2} AND step > {STEPS // 2} OR crs * crs * (m1 + m2) > {CHI2}::DOUBLE * spread THEN 1 ELSE 0 END AS edge FROM crossed),
            run AS (SELECT host, template, shps, step, sum(edge) OVER (PARTITION BY host, template, shps ORDER BY step) AS run FROM edged),
            class AS (SELECT t.host, t.template, t.seg, t.n, t.shps, CASE WHEN t.m = 0 THEN -2 WHEN t.m < {LABELS} THEN -1 ELSE r.run END AS lab FROM tested t
                LEFT JOIN run r ON r.host = t.host AND r.template = t.template AND r.shps = t.shps AND r.step = t.step),
            name AS (SELECT host, template, seg, first_value(seg) OVER (PARTITION BY host, template, lab, shps ORDER BY n DESC, seg) AS nam FROM class),
            node AS (SELECT c.host, c.template || '/' || coalesce(nam, '*') AS template FROM child c LEFT JOIN name x
                ON x.host = c.host AND x.template = c.template AND x.seg = c.seg GROUP BY ALL HAVING sum(c.n - c.s0) >= {LEAST})"""
    return f"""
        WITH RECURSIVE rules AS ({fits}),
        cut AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT rid, page_id,
            coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
        ruled AS (SELECT p.*, r.h || r.p AS rule, r.v AS rv, row_number() OVER (PARTITION BY rid ORDER BY length(r.h || r.p) DESC, r.h || r.p DESC) AS k
            FROM parts p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)),
        labelled AS (SELECT page_id, host, path, rule, rv, CASE WHEN rule IS NOT NULL THEN (rv = 'block')::INT END AS blocked,
            list_filter(string_split(path, '/'), lambda s: s <> '') AS rest FROM ruled WHERE k = 1),
        tree AS (SELECT 0 AS depth, page_id, host, path, rule, rv, blocked, rest, '' AS template, len(rest) > 0 AS opened FROM labelled
            UNION ALL (WITH {children}{level})),
        done AS (SELECT page_id, host, path, rule, rv, blocked, CASE WHEN len(rest) > 0 THEN template || '/**' ELSE template END AS template FROM tree WHERE NOT opened),
        overall AS (SELECT count(blocked) AS am, coalesce(sum(blocked), 0)::BIGINT AS ab FROM done),
        bad AS (SELECT host, template FROM (SELECT host, template, count(blocked) AS m, coalesce(sum(blocked), 0)::BIGINT AS b FROM done GROUP BY ALL), overall
            WHERE m > 0 AND b * (am + 2) * 2 + 2 * {PRIOR} * least(ab + 1, (am + 2) / 2) > (m + {PRIOR}) * (am + 2))
        SELECT d.page_id, d.host, d.path, d.rule, coalesce(d.rv, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, d.template
        FROM done d LEFT JOIN bad b USING (host, template)"""
