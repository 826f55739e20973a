"""The numbered structure of a contract: each paragraph's place, carried on from the headings before it, and references
to places that are not there.

Article, part, clause and paragraph carry on down the text and reset each other. The body and each column of a table are
streams of their own; a column without a heading yet stands where the body was at its beginning. p_idx tells a document's
paragraphs apart and orders them. They are one window, read as a stream; nothing of it is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.operators.match import spans

#: What articles are called, in headings and references. `M.` and the like are for references only.
CALLED = "(?iu:articles?|sections?|clauses?|madde(?:ler)?|maddə)"
SHORT = r"(?iu:art[.]|sec[.]|cl[.]|md[.])|§§?"
NUMBER = "[0-9]{1,3}(?:[.][0-9]{1,3})*"
BELOW = r"(?: ?[(] ?(?:[\p{L}]{1,2}|[ivxIVX]{1,5}|[0-9]{1,2}) ?[)])*"
HEADED = rf"^\s*{CALLED}\s+({NUMBER})(?=$|[\s.):–-])"
NUMBERED = r"^\s*([0-9]{1,3}(?:[.][0-9]{1,3})+)[.]?(?=$|[\s):–-])"
BARE = r"^\s*([0-9]{1,3})[.)–-](?=$|\s)"
PARAGRAPH = r"^\s*[(]([0-9]{1,2})[)](?=$|\s)"
CLAUSE = r"^\s*[(]?([\p{L}]|[ivxIVX]{1,5})[)](?=$|\s)"
#: A heading with more words than this says something itself: its text is the article's first paragraph.
TITLE = 8


def labelled(rows: DataFrame) -> DataFrame:
    """rows (doc_id, p_idx, stream, text) with kind and value of each paragraph's own number: `article`, `part` (7.3), `order` (a
    bare number), `paragraph` ((2)), `clause` ((b)) or `text`. A bare number is an article, unless two paragraphs or more of the
    document name their articles: then it counts within one."""
    get = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    headed, numbered, bare, paragraph, clause = (get(p) for p in (HEADED, NUMBERED, BARE, PARAGRAPH, CLAUSE))
    named = F.count_if(F.col("text").rlike(HEADED)).over(Window.partitionBy("doc_id")) >= 2
    own = F.coalesce(headed, numbered, bare)
    kind = (
        F.when(own.isNotNull() & F.contains(own, F.lit(".")), "part").when(headed.isNotNull(), "article").when(bare.isNotNull(), F.when(named, "order").otherwise("article"))
        .when(paragraph.isNotNull(), "paragraph").when(clause.isNotNull(), "clause").otherwise("text")
    )
    return rows.withColumns({"kind": kind, "value": F.when(kind == "clause", F.lower(clause)).otherwise(F.coalesce(own, paragraph))})


def placed(rows: DataFrame) -> DataFrame:
    """labelled rows with article, part, clause and paragraph, as carried on to each, and place (`7.3(b)`; null before the first
    article). clause ends with its part; paragraph counts the article's paragraphs of text."""
    here = Window.partitionBy("doc_id", "stream").orderBy("p_idx")
    along = Window.partitionBy("doc_id").orderBy("p_idx")
    article = F.when(F.col("kind") == "article", F.col("value")).when(F.col("kind") == "part", F.substring_index("value", ".", 1))
    moves = F.when(F.col("kind").isin("article", "part"), F.struct("p_idx", article.alias("article"), F.col("value").alias("part")))
    out = labelled(rows).withColumns({"__own": F.last(moves, True).over(here), "__body": F.last(F.when(F.col("stream") == "", moves), True).over(along)})
    # a stream stands where the body stood at its own first paragraph, until it has a heading
    out = out.withColumn("__at", F.coalesce("__own", F.first("__body").over(here)))
    out = out.withColumns({"article": F.col("__at.article"), "part": F.col("__at.part")})
    within = Window.partitionBy("doc_id", "stream", "__own").orderBy("p_idx")
    out = out.withColumn("__clause", F.last(F.when((F.col("kind") == "clause") & F.col("article").isNotNull(), F.col("value")), True).over(within))
    starts = F.sum(F.when(F.col("kind") == "article", 1).otherwise(0)).over(here)
    out = out.withColumn("__articles", starts)
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    says = F.when(F.col("kind") == "article", (words > TITLE).cast("int")).when(F.col("kind") == "text", F.col("article").isNotNull().cast("int")).otherwise(0)
    out = out.withColumn("paragraph", F.sum(says).over(Window.partitionBy("doc_id", "stream", "__articles").orderBy("p_idx")).cast("int"))
    below = F.when(F.col("kind") == "clause", F.concat(F.lit("("), "value", F.lit(")"))).otherwise("")
    return out.select(*(rows[c] for c in rows.columns), "kind", "value", "article", "part", F.col("__clause").alias("clause"), "paragraph", F.concat("part", below).alias("place"))


def places(rows: DataFrame) -> DataFrame:
    """(doc_id, grain, name): what placed rows have: articles, parts with all above them, clauses by part and article, paragraphs."""
    in_article = F.col("article").isNotNull()
    pieces = F.split("part", "[.]")
    parts = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "."))
    below = lambda top: F.concat(top, F.lit("("), F.col("value"), F.lit(")"))
    numbered = F.col("kind").isin("paragraph", "order")
    found = F.concat(
        F.array(F.struct(F.lit("article").alias("grain"), F.col("article").alias("name"))),
        F.transform(parts, lambda p: F.struct(F.lit("part").alias("grain"), p.alias("name"))),
        F.array(
            F.struct(F.lit("part").alias("grain"), F.when(F.col("kind") == "order", F.concat("article", F.lit("."), "value")).alias("name")),
            F.struct(F.lit("below").alias("grain"), F.when((F.col("kind") == "clause") | numbered, below(F.col("part"))).alias("name")),
            F.struct(F.lit("below").alias("grain"), F.when(F.col("kind") == "clause", below(F.col("article"))).alias("name")),
            F.struct(F.lit("paragraph").alias("grain"), F.when(numbered, F.concat("article", F.lit("/"), "value")).when(F.col("kind") == "part", F.concat("article", F.lit("/"), F.split_part("value", F.lit("."), F.lit(2)))).when(F.col("kind").isin("text", "article") & (F.col("paragraph") > 0), F.concat("article", F.lit("/"), "paragraph")).alias("name")),
        ),
    )
    return rows.where(in_article).select("doc_id", F.inline(found)).where("name is not null").distinct()


#: References: a name and numbers one after another (`Articles 7.3(b), 8 and 9`), or a number before the name in Turkish, with
#: its paragraph and clause (`7. maddenin 2. fıkrasının (b) bendi`). One pattern, so that each place is read once; first characters
#: come first, as most places have others, then what a word or a number must be followed by.
NEXT = rf"(?:\s*(?:,|and|or|to|ve|veya|ile|ila|–|-)\s*{NUMBER}{BELOW}(?![0-9.]*[0-9])(?!\s*(?iu:days?|months?|years?|weeks?|hours?|gün|ay|yıl|hafta|saat|%|TL|USD|EUR)))*"
ORDINAL = r"(?:['’]?\s*[ntc]{0,1}[ıiuü]?[ncı]{1,3}[ıiuü]?)?"
REFERENCE = (
    rf"(?=[acsmACSM\u017f§])(?<![\p{{L}}0-9.])(?=\p{{L}}*+[.§]{{0,2}}\s*+[0-9])(?:{CALLED}|{SHORT})\s*{NUMBER}(?![0-9]){BELOW}{NEXT}"
    rf"|(?=[0-9])(?<![0-9.])(?=[0-9.]++\s*+['’]?\s*+[ntcıiuümM])(?<!\p{{L}}){NUMBER}[.]?\s*{ORDINAL}\s*(?iu:madde)\p{{L}}*(?:\s+[(]?[0-9]{{1,2}}[)]?[.]?\s*{ORDINAL}\s*(?iu:fıkra)\p{{L}}*)?(?:\s+[(]?\p{{L}}[)]?\s+(?iu:bend)\p{{L}}*)?"
)
#: What stands right before a reference to a statute, or right after one.
STATUTE = r"(?=\p{L}++[,]?\s*$)(?iu:kanun|yönetmeli|tebliğ|tüzü|kararname|anayasa|sayılı|convention|directive|regulation|act|law|code|treaty|statute|gdpr)\p{L}{0,8}[,]?\s*$"
OF_ANOTHER = r"^\s*(?:of|under)\s+(?:the\s+)?(?!(?i:this|agreement|contract|deed|annex|schedule|appendix|exhibit)\b)[A-Z]"


def references(rows: DataFrame) -> DataFrame:
    """(doc_id, p_idx, start, part, below, paragraph): references of paragraphs (doc_id, p_idx, text) to parts of their own document,
    without their own numbers and those of statutes. below is like `(b)(ii)`, or empty; paragraph is null if none is told."""
    found = rows.select("doc_id", "p_idx", F.col("text").alias("whole"), F.inline(spans(F.col("text"), REFERENCE)))
    left, right = F.substring("whole", F.greatest(F.col("start") - 39, F.lit(1)), F.least("start", F.lit(40))), F.substring("whole", F.col("end") + 1, F.lit(60))
    own = F.trim(left).eqNullSafe("") & (F.col("start") < 40) & F.col("whole").rlike(f"{HEADED}|{NUMBERED}")
    found = found.where(~own & ~left.rlike(STATUTE) & ~right.rlike(OF_ANOTHER))
    turkish = F.col("text").rlike(r"^[0-9]")
    clause = F.regexp_extract("text", r"(?iu)\s[(]?(\p{L})[)]?\s+bend", 1)
    one = F.array(F.concat(F.regexp_extract("text", f"^({NUMBER})", 1), F.when(clause != "", F.concat(F.lit("("), F.lower(clause), F.lit(")"))).otherwise("")))
    each = F.when(turkish, one).otherwise(F.regexp_extract_all("text", F.lit(rf"({NUMBER}{BELOW})"), F.lit(1)))
    paragraph = F.when(turkish, F.nullif(F.regexp_extract("text", r"(?iu)([0-9]{1,2})[)]?[.]?\s*\S*\s*fıkra", 1), F.lit("")))
    rows = found.select("doc_id", "p_idx", "start", F.explode(each).alias("r"), paragraph.alias("paragraph"))
    # a number in parentheses belongs to what is before it, not to the list
    return rows.select("doc_id", "p_idx", "start", F.regexp_extract("r", f"^({NUMBER})", 1).alias("part"), F.lower(F.regexp_replace(F.regexp_replace("r", f"^{NUMBER}", ""), " ", "")).alias("below"), "paragraph")


def dangling(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, p_idx, start, part, below, paragraph, rule): references to what their document does not have, by the coarsest
    grain that is missing: `article`, else `part` (also a clause or a paragraph). A document without articles is left alone. What
    meets is dealt to so many tasks, if that is given: else by its size as it is compressed, which says little of its rows."""
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    there = places(placed(rows)).withColumn("__has", F.lit(True))
    asked = references(rows).join(there.where("grain = 'article'").select("doc_id").distinct(), "doc_id", "left_semi")
    article = F.substring_index("part", ".", 1)
    names = F.array_compact(
        F.array(
            F.struct(F.lit("article").alias("need"), F.lit("article").alias("grain"), article.alias("name")),
            F.struct(F.lit("part").alias("need"), F.lit("part").alias("grain"), F.col("part").alias("name")),
            F.when(F.col("below") != "", F.struct(F.lit("below").alias("need"), F.lit("below").alias("grain"), F.concat("part", F.regexp_extract("below", "^([(][^)]*[)])", 1)).alias("name"))),
            F.when(F.col("below") != "", F.struct(F.lit("below").alias("need"), F.lit("below").alias("grain"), F.concat(article, F.regexp_extract("below", "^([(][^)]*[)])", 1)).alias("name"))),
            F.when(F.col("paragraph").isNotNull(), F.struct(F.lit("paragraph").alias("need"), F.lit("paragraph").alias("grain"), F.concat(article, F.lit("/"), "paragraph").alias("name"))),
            F.when(F.col("paragraph").isNotNull(), F.struct(F.lit("paragraph").alias("need"), F.lit("part").alias("grain"), F.concat("part", F.lit("."), "paragraph").alias("name"))),
        )
    )
    ref = ["doc_id", "p_idx", "start", "part", "below", "paragraph"]
    place = ["doc_id", "grain", "name"]
    met = dealt(asked.select(*ref, F.inline(names)), *place).join(dealt(there, *place), place, "left")
    # of each need, one of its names is enough
    needs = dealt(met, "doc_id").groupBy(*ref, "need").agg(F.max(F.coalesce("__has", F.lit(False))).alias("ok")).where("not ok")
    rule = F.when(F.max(F.col("need") == "article"), "article").otherwise("part")
    return needs.groupBy(*ref).agg(rule.alias("rule"))
