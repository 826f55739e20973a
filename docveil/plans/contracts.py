"""Contracts made of order lines, a paragraph a line, for the operators on structure: their numbers follow from the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docveil.operators import structure
from docveil.operators.staging import spread, tasks
from docveil.plans.queries import table

#: A paragraph's text by l_partkey % 6, and its stream by l_suppkey % 5. Both engines read this SQL.
_N = "cast(l_suppkey % 9 + 1 as varchar(9))"
TEXT = f"""CASE l_partkey % 6 WHEN 0 THEN 'Article ' || {_N} || ' Terms' WHEN 1 THEN {_N} || '.' || cast(l_linenumber % 3 + 1 as varchar(9)) || ' Text of a part' WHEN 2 THEN '(' || chr(cast(97 + l_suppkey % 4 as int)) || ') a clause'
    WHEN 3 THEN '(' || cast(l_suppkey % 3 + 1 as varchar(9)) || ') a paragraph' WHEN 4 THEN 'Text that goes on, see Article ' || {_N} || ' and ' || cast(l_linenumber % 3 + 1 as varchar(9)) || '.' || cast(l_suppkey % 3 + 1 as varchar(9)) ELSE {_N} || '. A bare number' END"""
STREAM = "CASE l_suppkey % 5 WHEN 3 THEN 'c1' WHEN 4 THEN 'c2' ELSE '' END"
#: A line's place in its order: line numbers repeat in the table.
PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spread(lines, "l_orderkey").selectExpr("l_orderkey AS doc_id", f"{PLACE} AS p_idx", f"{STREAM} AS stream", f"{TEXT} AS text")


def structure_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.placed(contract_rows(spark, sf_dir)).select("doc_id", "p_idx", "kind", "article", "part", "clause", "paragraph", "place")


#: One paragraph after another, with the state of the body and of both columns.
_PLACED = f"""x AS (SELECT l_orderkey AS o, ({PLACE})::INT AS p, {PLACE} AS i, 1 + list_position(['', 'c1', 'c2'], {STREAM}) - 1 AS s, {TEXT} AS t,
        l_partkey % 6 AS q, count(*) FILTER (WHERE l_partkey % 6 = 0) OVER (PARTITION BY l_orderkey) >= 2 AS named FROM lineitem),
    l AS (SELECT *, CASE q WHEN 0 THEN 'article' WHEN 1 THEN 'part' WHEN 2 THEN 'clause' WHEN 3 THEN 'paragraph' WHEN 4 THEN 'text' ELSE CASE WHEN named THEN 'order' ELSE 'article' END END AS k,
        CASE q WHEN 0 THEN split_part(t, ' ', 2) WHEN 1 THEN split_part(t, ' ', 1) WHEN 2 THEN t[2] WHEN 3 THEN t[2] WHEN 5 THEN split_part(t, '.', 1) END AS v FROM x),
    r AS (SELECT DISTINCT o, 0::BIGINT AS i, [{{'seen': false, 'a': NULL::VARCHAR, 'p': NULL::VARCHAR, 'c': NULL::VARCHAR, 'n': 0}} FOR z IN [1, 2, 3]] AS st, NULL::INT AS p, NULL::VARCHAR AS k, NULL::VARCHAR AS v, 1::BIGINT AS s FROM l UNION ALL
        SELECT o, i, [CASE WHEN z = s THEN now ELSE st[z] END FOR z IN [1, 2, 3]], p, k, v, s FROM (SELECT *, {{'seen': true,
            'a': CASE k WHEN 'article' THEN v WHEN 'part' THEN split_part(v, '.', 1) ELSE cur.a END, 'p': CASE WHEN k IN ('article', 'part') THEN v ELSE cur.p END,
            'c': CASE WHEN k IN ('article', 'part') THEN NULL WHEN k = 'clause' AND cur.a IS NOT NULL THEN v ELSE cur.c END,
            'n': CASE WHEN k = 'article' THEN 0 WHEN k = 'text' AND cur.a IS NOT NULL THEN cur.n + 1 ELSE cur.n END}} AS now
            FROM (SELECT l.o, l.i, l.p, l.k, l.v, l.s, r.st, CASE WHEN r.st[l.s].seen THEN r.st[l.s] ELSE {{'seen': true, 'a': r.st[1].a, 'p': r.st[1].p, 'c': NULL, 'n': 0}} END AS cur FROM r JOIN l ON l.o = r.o AND l.i = r.i + 1))),
    placed AS (SELECT o, p, k, v, st[s].a AS a, st[s].p AS part, st[s].c AS c, st[s].n AS n FROM r WHERE i > 0)"""
PLACES_SQL = f"""WITH RECURSIVE {_PLACED} SELECT o AS doc_id, p AS p_idx, k AS kind, a AS article, part, c AS clause, n AS paragraph, part || CASE WHEN k = 'clause' THEN '(' || v || ')' ELSE '' END AS place FROM placed"""


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.dangling(contract_rows(spark, sf_dir), tasks(table(spark, sf_dir, "lineitem"))).select("doc_id", "p_idx", "part", "rule")


#: The two references of every paragraph of text, against the articles and parts that the document has.
DANGLING_SQL = f"""WITH RECURSIVE {_PLACED},
    has AS (SELECT DISTINCT o, a AS name FROM placed WHERE a IS NOT NULL UNION SELECT o, part FROM placed WHERE part IS NOT NULL UNION SELECT o, a || '.' || v FROM placed WHERE k = 'order' AND a IS NOT NULL),
    asked AS (SELECT o, p, unnest([regexp_extract(t, 'Article ([0-9]+)', 1), regexp_extract(t, 'and ([0-9.]+)', 1)]) AS name FROM x WHERE q = 4 AND o IN (SELECT o FROM has))
    SELECT o AS doc_id, p AS p_idx, name AS part, CASE WHEN EXISTS (SELECT 1 FROM placed h WHERE h.o = asked.o AND h.a = split_part(asked.name, '.', 1)) THEN 'part' ELSE 'article' END AS rule
    FROM asked WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.o = asked.o AND has.name = asked.name)"""

QUERIES = {"structure_places": (structure_places, PLACES_SQL), "dangling_references": (dangling_references, DANGLING_SQL)}
