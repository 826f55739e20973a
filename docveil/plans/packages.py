"""Documents and order lines as DOCX packages: two versions with tracked changes, and revisions, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators import diff
from docveil.operators.staging import spread
from docveil.plans.queries import documents, table
from docveil.sources import markdown, tracked


def _lines(text: str) -> F.Column:
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(x.alias("text"), F.lit(None).cast("array<array<string>>").alias("rows")))


def _text(blocks: str) -> F.Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def tracked_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as two versions: what accepting and rejecting all changes of their package gives."""
    docs = documents(spark, sf_dir).select(F.expr("doc_id div 2").alias("pair_id"), (F.col("doc_id") % 2).alias("side"), _lines("text").alias("blocks"))
    pairs = docs.groupBy("pair_id").agg(F.first(F.when(F.col("side") == 0, F.col("blocks")), True).alias("old"), F.first(F.when(F.col("side") == 1, F.col("blocks")), True).alias("new"))
    read = tracked.versions(tracked.tracked(pairs), ["pair_id", "changes"], ("accepted", "rejected"))
    return read.select("pair_id", (F.col("changes") > 0).alias("changed"), F.sha2(_text("accepted"), 256).alias("accepted_sha256"), F.sha2(_text("rejected"), 256).alias("rejected_sha256"))


TRACKED_SQL = """SELECT doc_id // 2 AS pair_id, coalesce(max(text) FILTER (WHERE doc_id % 2 = 0), '') <> coalesce(max(text) FILTER (WHERE doc_id % 2 = 1), '') AS changed,
    sha256(coalesce(max(text) FILTER (WHERE doc_id % 2 = 1), '')) AS accepted_sha256, sha256(coalesce(max(text) FILTER (WHERE doc_id % 2 = 0), '')) AS rejected_sha256 FROM documents GROUP BY ALL"""

#: A line's row in an order's table, then what the new version has of it: nothing, other cells, one more cell or the same.
ROW = "array(cast(l_partkey as string), cast(l_suppkey as string), concat('part ', l_partkey, ' of ', l_suppkey))"
NEW_ROW = f"CASE l_partkey % 5 WHEN 1 THEN array(cast(l_partkey as string), cast(l_suppkey + 1 as string), concat('part ', l_partkey, ' of ', l_suppkey)) WHEN 2 THEN array_append({ROW}, 'new') ELSE {ROW} END"


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, old, new): each order's table of lines, in two versions."""
    # packages take long for the bytes that they are made of: orders are dealt by number of lines
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", 25_000)
    rows = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(ROW).alias("old"), F.expr(f"CASE WHEN l_partkey % 5 <> 0 THEN {NEW_ROW} END").alias("new")).alias("r"))
    own = rows.groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return own.select("pair_id", F.transform("rows", lambda r: r["old"]).alias("old"), F.filter(F.transform("rows", lambda r: r["new"]), lambda r: r.isNotNull()).alias("new"))


def tracked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a package of both versions' tables has with all changes accepted, and with all rejected."""
    block = lambda c: F.array(F.struct(F.lit(None).cast("string").alias("text"), F.col(c).alias("rows")))
    pairs = order_tables(spark, sf_dir).select("pair_id", block("old").alias("old"), block("new").alias("new"))
    read = tracked.versions(tracked.tracked(pairs), ["pair_id"], ("accepted", "rejected"))
    flat = lambda c: F.array_join(F.transform(F.flatten(F.transform(c, lambda b: b["rows"])), lambda r: F.array_join(r, "|")), "\n")
    return read.select("pair_id", flat("accepted").alias("accepted"), flat("rejected").alias("rejected"))


TABLES_SQL = """SELECT l_orderkey AS pair_id, coalesce(string_agg(CASE l_partkey % 5 WHEN 1 THEN concat(l_partkey, '|', l_suppkey + 1, '|part ', l_partkey, ' of ', l_suppkey)
        WHEN 2 THEN concat(l_partkey, '|', l_suppkey, '|part ', l_partkey, ' of ', l_suppkey, '|new') ELSE concat(l_partkey, '|', l_suppkey, '|part ', l_partkey, ' of ', l_suppkey) END, chr(10)
        ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_partkey % 5 <> 0), '') AS accepted,
    string_agg(concat(l_partkey, '|', l_suppkey, '|part ', l_partkey, ' of ', l_suppkey), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS rejected FROM lineitem GROUP BY ALL"""


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every row and cell of the orders' tables."""
    return diff.compare_tables(order_tables(spark, sf_dir)).select("pair_id", "position", "kind", "old_row", "new_row", F.array_join(F.transform("cells", lambda c: F.concat(c["kind"], F.lit(":"), c["column"])), ",").alias("cells"))


def tracked_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision of every document: twelve characters from its middle give way to its number, in a package and back."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    pages = tracked.tracked(docs.select(F.col("path").alias("pair_id"), _lines("text").alias("old"), _lines("text").alias("new"))).select(F.col("pair_id").alias("path"), "content")
    asked = docs.select("path", F.lit(1).alias("position"), F.expr("substring(text, length(text) div 2 + 1, 12)").alias("old"), F.concat(F.lit("No. "), "path").alias("new"), (F.col("path") % 2 == 0).alias("every"))
    done = tracked.revised(pages, asked).select(F.col("path").alias("doc_id"), F.col("results")[0]["status"].alias("status"), "content")
    read = tracked.versions(done, ["doc_id", "status"], ("accepted", "rejected"))
    return read.select("doc_id", "status", F.sha2(_text("accepted"), 256).alias("accepted_sha256"), F.sha2(_text("rejected"), 256).alias("rejected_sha256"))


#: A place is held if the text there goes over a tab, which is an element of its own in a package.
REVISIONS_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), (length(coalesce(text, '')) // 2 + 1)::BIGINT, 12) AS o, 'No. ' || doc_id AS n FROM documents),
    s AS (SELECT *, CASE WHEN o = '' THEN 'empty' WHEN contains(o, chr(10)) THEN 'crosses a paragraph' WHEN doc_id % 2 = 1 AND length(t) - length(replace(t, o, '')) > length(o) THEN 'several places'
        WHEN contains(o, chr(9)) THEN 'tracked or no plain text' ELSE 'applied' END AS status FROM d)
    SELECT doc_id, status, sha256(CASE status WHEN 'applied' THEN replace(t, o, n) ELSE t END) AS accepted_sha256, sha256(t) AS rejected_sha256 FROM s"""


def markdown_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as Markdown with a heading, a bullet and a table of its lines, in a package, and read as Markdown again."""
    line = F.concat(F.lit("| "), "l_partkey", F.lit(" | "), "l_suppkey", F.lit(" | part\\|"), "l_returnflag", F.lit("<br>"), "l_linestatus", F.lit(" |"))
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", 100_000)
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("r"))
    text = F.concat(F.lit("## Order "), "l_orderkey", F.lit("\n\nIt has **"), F.size("r"), F.lit("** lines & more:\n| part | supplier | <flag> |\n|---|---|---|\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n- end"))
    read = markdown.views(markdown.packages(rows.select(F.col("l_orderkey").alias("path"), text.alias("markdown"))))
    return read.select(F.col("path").alias("l_orderkey"), "markdown")


MARKDOWN_SQL = """SELECT l_orderkey, '## Order ' || l_orderkey || chr(10) || chr(10) || 'It has ' || count(*) || ' lines & more:' || chr(10) || chr(10) || '| part | supplier | <flag> |' || chr(10) || '|---|---|---|' || chr(10)
    || string_agg('| ' || l_partkey || ' | ' || l_suppkey || ' | part\\|' || l_returnflag || '<br>' || l_linestatus || ' |', chr(10) ORDER BY l_linenumber, l_partkey::VARCHAR || ' | ' || l_suppkey || ' | part' || l_returnflag || l_linestatus)
    || chr(10) || chr(10) || '• end' AS markdown FROM lineitem GROUP BY l_orderkey"""

QUERIES = {
    "markdown_views": (markdown_views, MARKDOWN_SQL),
    "tracked_versions": (tracked_versions, TRACKED_SQL),
    "tracked_tables": (tracked_tables, TABLES_SQL),
    "table_rows": (table_rows, None),
    "tracked_revisions": (tracked_revisions, REVISIONS_SQL),
}
