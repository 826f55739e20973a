"""Queries of overlaps, places, numbers, audits and review over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import numerals
from docveil.functions.morphology import VOWELS, inflected
from docveil.functions.textfold import tr_lower
from docveil.operators import audit, filters, masking, numbering, reports, resolve, review, rules, vault
from docveil.operators.staging import spread
from docveil.plans.queries import BY_NAME, COMMON, FOUND_SQL, LABELS_SQL, PARAGRAPHS_SQL, SHOWN_SQL, documents, found, table

#: What suffix_harmony puts on words, by their length.
SUFFIXES = ["in", "lerinde", "ye", "den", "la", "dir", "deki", "xyz"]


def suffix_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with one of SUFFIXES in its own harmony."""
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(tr_lower(F.col("text")), F.lit("([a-zçğıöşüâîû]+)"), F.lit(1))).alias("word")).distinct()
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), F.length("word") % len(SUFFIXES))
    return words.select("word", inflected(F.col("word"), suffix).alias("suffix"))


HARMONY_SQL = f"""SELECT word, CASE WHEN v = '' THEN {SUFFIXES}[k] ELSE [CASE WHEN e THEN 'n' ELSE '' END || i || 'n', 'l' || a || 'r' || CASE a WHEN 'a' THEN 'ı' ELSE 'i' END || 'nd' || a,
        CASE WHEN e THEN 'y' ELSE '' END || a, d || a || 'n', CASE WHEN e THEN 'yl' ELSE 'l' END || a, d || i || 'r', d || a || 'ki', 'xyz'][k] END AS suffix
    FROM (SELECT *, length(word) % {len(SUFFIXES)} + 1 AS k, CASE WHEN v IN ('a', 'ı', 'o', 'u', 'â', 'û') THEN 'a' ELSE 'e' END AS a,
            CASE WHEN v IN ('a', 'ı', 'â', 'û') THEN 'ı' WHEN v IN ('o', 'u') THEN 'u' WHEN v IN ('ö', 'ü') THEN 'ü' ELSE 'i' END AS i,
            CASE WHEN contains('fstkçşhp', right(word, 1)) THEN 't' ELSE 'd' END AS d, contains('{VOWELS}', right(word, 1)) AS e
        FROM (SELECT word, regexp_extract(word, '([{VOWELS}])[^{VOWELS}]*$', 1) AS v
            FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(translate(text, 'Iİ', 'ıi')), '[a-zçğıöşüâîû]+')) AS word FROM documents)))"""


def overlap_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as findings on one text an order: those kept, and the suspects that overlap none of them."""
    q = "cast(l_partkey % 40 as int) AS start, cast(l_partkey % 40 + l_quantity % 9 + 1 as int) AS end, l_returnflag AS entity, l_linestatus AS label_type, cast(30 + l_suppkey % 50 as int) AS score, '' AS text, cast(l_partkey as string) AS canonical"
    source = "CASE l_linenumber WHEN 7 THEN 'dictionary' WHEN 1 THEN 'propagated' ELSE 'rule' END AS source"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(f"struct({q}, {source})").alias("f"))
    rows = lines.groupBy("l_orderkey").agg(F.collect_list("f").cast(rules.FINDINGS).alias("c"))
    rows = rows.withColumn("kept", resolve.resolve(filters.certain(F.col("c"))))
    rows = rows.withColumn("suspects", resolve.resolve(filters.suspects(F.col("c"), F.col("kept"))))
    sides = [rows.select("l_orderkey", F.lit(k).alias("kind"), F.inline(k)).select("l_orderkey", "kind", "start", "end", "entity", "canonical") for k in ("kept", "suspects")]
    return sides[0].unionByName(sides[1])


_LINES_SQL = """SELECT l_orderkey AS o, (l_partkey % 40)::INT AS s, (l_partkey % 40 + l_quantity % 9 + 1)::INT AS e, l_returnflag AS g, l_linestatus AS t, (30 + l_suppkey % 50)::INT AS score, l_partkey::VARCHAR AS c,
    CASE l_linenumber WHEN 7 THEN 'dictionary' WHEN 1 THEN 'propagated' ELSE 'rule' END AS source FROM lineitem"""
_RANK_SQL = "row_number() OVER (PARTITION BY o ORDER BY CASE source WHEN 'dictionary' THEN 0 ELSE 1 END, score DESC, s - e, CASE source WHEN 'propagated' THEN 1 ELSE 0 END, s, g, c, t, source) AS k"


def _greedy_sql(name: str, rows: str) -> str:
    return f"""{name}_x AS (SELECT *, {_RANK_SQL} FROM ({rows})),
    {name}_r AS (SELECT DISTINCT o, 0::BIGINT AS k, []::STRUCT(s INT, e INT, g VARCHAR, c VARCHAR)[] AS kept FROM {name}_x UNION ALL
        SELECT r.o, x.k, CASE WHEN len(list_filter(r.kept, lambda q: q.s < x.e AND x.s < q.e)) > 0 THEN r.kept ELSE list_append(r.kept, {{'s': x.s, 'e': x.e, 'g': x.g, 'c': x.c}}) END
        FROM {name}_r r JOIN {name}_x x ON x.o = r.o AND x.k = r.k + 1),
    {name}_f AS (SELECT o, unnest(kept, recursive := true) FROM (SELECT o, arg_max(kept, k) AS kept FROM {name}_r GROUP BY o))"""


GREEDY_SQL = f"""WITH RECURSIVE l AS ({_LINES_SQL}), {_greedy_sql('a', 'SELECT * FROM l WHERE score >= 50')},
    {_greedy_sql('b', 'SELECT * FROM l WHERE score BETWEEN 30 AND 49 AND NOT EXISTS (SELECT 1 FROM a_f WHERE a_f.o = l.o AND a_f.s < l.e AND l.s < a_f.e)')}
    SELECT o AS l_orderkey, 'kept' AS kind, s AS start, e AS "end", g AS entity, c AS canonical FROM a_f UNION ALL SELECT o, 'suspects', s, e, g, c FROM b_f"""


#: The cuts of `protected_chunks`: a cut at a line end, else a space, of a part's second half, moved off a finding.
CHUNKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(spans, []) AS spans
        FROM documents LEFT JOIN (SELECT doc_id, list({{'a': s, 'b': e}}) AS spans FROM ({FOUND_SQL}) GROUP BY doc_id) USING (doc_id)),
    r AS (SELECT doc_id, 0 AS part, 0::BIGINT AS s, 0::BIGINT AS e FROM d UNION ALL
        SELECT doc_id, part + 1, e, coalesce(list_filter(list_transform(spans, lambda q: CASE WHEN q.a < c AND c < q.b THEN CASE WHEN q.a > e THEN q.a ELSE q.b END END), lambda x: x IS NOT NULL)[1], c)
        FROM (SELECT doc_id, part, e, spans, CASE WHEN e + 2000 >= n THEN n WHEN contains(half, chr(10)) THEN e + 2001 - strpos(reverse(half), chr(10)) WHEN contains(half, ' ') THEN e + 2001 - strpos(reverse(half), ' ') ELSE e + 2000 END AS c
            FROM (SELECT *, substr(t, e + 1001, 1000) AS half FROM r JOIN d USING (doc_id) WHERE e < n)))
    SELECT doc_id, part::INT AS part, s::INT AS start, e::INT AS "end" FROM r WHERE part > 0 UNION ALL SELECT doc_id, 1, 0, 0 FROM d WHERE n = 0"""


def finding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their paragraph, their place in it and what stands around them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = rules.detect(docs, COMMON).select("doc_id", "text", F.inline(F.transform("candidates", lambda f: F.struct(f["start"], f["end"], f["entity"]))))
    shown = rows.withColumn("excerpt", reports.excerpt(F.col("text"), F.col("start"), F.col("end"))).drop("text")
    return reports.located(shown, audit.paragraphs(docs)).select("doc_id", "start", "entity", "p_idx", "at", "excerpt")


CONTEXT_SQL = rf"""WITH p AS ({PARAGRAPHS_SQL}), f AS (SELECT doc_id, entity, s, e, full_text AS t, greatest(s - 80, 0) AS a, least(e + 80, length(full_text)) AS b FROM ({FOUND_SQL})),
    w AS (SELECT *, a - length(regexp_extract(substr(t, 1, a), '[^ \t\r\n\f\v]*\z')) AS x, b + length(regexp_extract(substr(t, b + 1), '^[^ \t\r\n\f\v]*')) AS y FROM f)
    SELECT doc_id, s AS start, entity, (SELECT max(p_idx) FROM p WHERE p.doc_id = w.doc_id AND p.start <= w.s) AS p_idx, (s - (SELECT max(start) FROM p WHERE p.doc_id = w.doc_id AND p.start <= w.s))::INT AS at,
        CASE WHEN x > 0 THEN '…' ELSE '' END || regexp_replace(substr(t, (x + 1)::BIGINT, (y - x)::BIGINT), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+\z', '', 'g') || CASE WHEN y < length(t) THEN '…' ELSE '' END AS excerpt FROM w"""

#: (level, start, form, shown) of the list that auto_numbers counts.
STYLE = [(0, 1, "decimal", "%1."), (1, 3, "decimalZero", "%1.%2"), (2, 1, "lowerLetter", "%1.%2(%3)"), (3, 1, "upperRoman", "%4)"), (4, 1, "bullet", "-")]


def auto_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as list paragraphs of their user, at a level by the event's number."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("list_id"), F.col("event_id").alias("p_idx"), (F.col("event_id") * 7 % 11 % 5).cast("int").alias("level"))
    levels = spark.createDataFrame([(1, *s) for s in STYLE], "list_id int, level int, start int, form string, shown string")
    return numbering.auto_numbers(rows, levels).select("doc_id", "p_idx", "level", "label")


def _roman(n: int) -> str:
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
        while n >= value:
            out, n = out + sign, n - value
    return out or "0"


ROMANS = [_roman(n) for n in range(400)]
#: Each level's number by counting rows after the last one of a higher level.
NUMBERS_SQL = f"""WITH x AS (SELECT user_id AS d, event_id AS p, (event_id * 7 % 11 % 5)::INT AS l FROM events),
    n AS (SELECT a.d, a.p, a.l, {', '.join(f"greatest(count(*) FILTER (WHERE b.l = {k} AND b.p > coalesce((SELECT max(c.p) FROM x c WHERE c.d = a.d AND c.p <= a.p AND c.l < {k}), -1)), 1) AS n{k}" for k in range(4))}
        FROM x a JOIN x b ON a.d = b.d AND b.p <= a.p GROUP BY a.d, a.p, a.l)
    SELECT d AS doc_id, p AS p_idx, l AS level, CASE l WHEN 0 THEN n0 || '.' WHEN 1 THEN n0 || '.' || lpad((n1 + 2)::VARCHAR, greatest(2, length((n1 + 2)::VARCHAR))::INT, '0')
        WHEN 2 THEN n0 || '.' || lpad((n1 + 2)::VARCHAR, greatest(2, length((n1 + 2)::VARCHAR))::INT, '0') || '(' || repeat(chr((97 + (n2 - 1) % 26)::INT), ((n2 - 1) // 26 + 1)::BIGINT) || ')'
        WHEN 3 THEN upper({ROMANS[:100]}[n3 + 1]) || ')' END AS label FROM n"""


def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % len(ROMANS)).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(numerals.formatted(n, F.lit(f)).alias(f) for f in ("lowerRoman", "upperRoman", "lowerLetter", "upperLetter", "decimalZero")))


FORMS_SQL = f"""SELECT o_orderkey, r AS "lowerRoman", upper(r) AS "upperRoman", a AS "lowerLetter", upper(a) AS "upperLetter", CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS "decimalZero"
    FROM (SELECT o_orderkey, n, {ROMANS}[n + 1] AS r, CASE WHEN n = 0 THEN '0' ELSE repeat(chr((97 + (n - 1) % 26)::INT), (n - 1) // 26 + 1) END AS a FROM (SELECT o_orderkey, o_orderkey % {len(ROMANS)} AS n FROM orders))"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short contract for every order, with faults by its key: a missing part, a second legal form, terms that nobody uses."""
    k = F.col("o_orderkey")
    lines = [
        F.lit("1. Definitions"),
        F.concat(F.lit("“Alpha Works” means one. “Beta Works” means two."), F.when(k % 2 == 0, " Alpha Works and Beta Works are used.").otherwise("")),
        F.lit("2. Scope"),
        F.concat(F.lit("See Section "), (k % 3 + 1).cast("string")),
        F.when(k % 5 == 0, "Mavi Deniz A.Ş. and Mavi Deniz Ltd. came").otherwise("none came"),
    ]
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit_findings(contracts(spark, sf_dir))


AUDIT_SQL = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w, v)::INT AS no, r AS rule, CASE WHEN w < 2 THEN 'high' ELSE 'medium' END AS severity, p AS p_idx, v AS value FROM
    (SELECT o_orderkey AS doc_id, 0 AS w, 'missing_reference' AS r, 3 AS p, '3' AS v FROM orders WHERE o_orderkey % 3 = 2 UNION ALL
     SELECT o_orderkey, 1, 'party_form', NULL, 'mavi deniz: A.Ş., Ltd.' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
     SELECT o_orderkey, 2, 'unused_term', NULL, unnest(['Alpha Works', 'Beta Works']) FROM orders WHERE o_orderkey % 2 = 1)"""


def audit_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.roll_up(audit_findings(spark, sf_dir))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents given back with a vault of e-mails only."""
    masked = masking.mask_documents(documents(spark, sf_dir), COMMON)
    labels = vault.number_values(found(spark, sf_dir, [BY_NAME["email"]]))
    out = review.delivered(masked.select("doc_id", "matter_id", F.col("masked").alias("text")), labels)
    return out.select("doc_id", F.sha2("unmasked", 256).alias("sha256"), F.col("resolved").cast("long").alias("resolved"), F.array_join("unknown", ",").alias("unknown"))


DELIVERED_SQL = f"""WITH f AS ({FOUND_SQL}), l AS ({LABELS_SQL}), v AS (SELECT matter_id, label_type, canonical, first(m ORDER BY length(m) DESC, m) AS main FROM f GROUP BY ALL),
    x AS (SELECT f.doc_id, f.full_text, f.s, f.e, label_type, {SHOWN_SQL} AS label, main, coalesce(lag(f.e) OVER (PARTITION BY f.doc_id ORDER BY f.s), 0) AS before
          FROM f JOIN l USING (matter_id, label_type, canonical) JOIN v USING (matter_id, label_type, canonical)),
    y AS (SELECT doc_id, string_agg(substr(full_text, before + 1, s - before) || CASE label_type WHEN 'EPOSTA' THEN main ELSE label END, '' ORDER BY s) || substr(any_value(full_text), max(e) + 1) AS back,
          count(*) FILTER (WHERE label_type = 'EPOSTA') AS n, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label_type <> 'EPOSTA')), ',') AS unknown FROM x GROUP BY doc_id)
    SELECT d.doc_id, sha256(coalesce(back, text)) AS sha256, coalesce(n, 0) AS resolved, coalesce(unknown, '') AS unknown FROM documents d LEFT JOIN y USING (doc_id)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = masking.mask_documents(documents(spark, sf_dir), COMMON)
    return review.listing(masked, vault.number_values(found(spark, sf_dir))).select("doc_id", "matter_id", F.col("characters").cast("long").alias("characters"), F.col("labels").cast("long").alias("labels"))


LISTING_SQL = f"""WITH f AS ({FOUND_SQL}), l AS ({LABELS_SQL}), x AS (SELECT f.doc_id, f.s, f.e, {SHOWN_SQL} AS label FROM f JOIN l USING (matter_id, label_type, canonical))
    SELECT doc_id, source AS matter_id, length(text) + coalesce(delta, 0)::BIGINT AS characters, coalesce(n, 0) AS labels
    FROM documents LEFT JOIN (SELECT doc_id, sum(length(label) - (e - s)) AS delta, count(DISTINCT label) AS n FROM x GROUP BY doc_id) USING (doc_id)"""


def revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one revision that has to be unambiguous and one of all places."""
    docs = documents(spark, sf_dir)
    wanted = [docs.select("doc_id", F.lit(o).alias("old"), F.lit(n).alias("new"), F.lit(a).alias("all")) for o, n, a in ((" outre", " neu", False), ("the", "ze", True))]
    return review.revised(docs, wanted[0].unionByName(wanted[1])).select("doc_id", F.sha2("revised", 256).alias("sha256"), "applied", "refused")


REVISED_SQL = """SELECT doc_id, sha256(replace(CASE WHEN n = 1 THEN replace(text, ' outre', ' neu') ELSE text END, 'the', 'ze')) AS sha256, (a + b)::INT AS applied, (2 - a - b)::INT AS refused
    FROM (SELECT *, CASE WHEN n = 1 THEN 1 ELSE 0 END AS a, CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END AS b FROM (SELECT doc_id, text, (length(text) - length(replace(text, ' outre', ''))) // 6 AS n FROM documents))"""


QUERIES = {
    "suffix_harmony": (suffix_harmony, HARMONY_SQL),
    "overlap_greedy": (overlap_greedy, GREEDY_SQL),
    "finding_context": (finding_context, CONTEXT_SQL),
    "auto_numbers": (auto_numbers, NUMBERS_SQL),
    "number_forms": (number_forms, FORMS_SQL),
    "audit_findings": (audit_findings, AUDIT_SQL),
    "audit_roll_up": (audit_roll_up, f"SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, 0::BIGINT AS low FROM ({AUDIT_SQL}) GROUP BY doc_id"),
    "delivered": (delivered, DELIVERED_SQL),
    "listing": (listing, LISTING_SQL),
    "revised": (revised, REVISED_SQL),
}
