"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import checks, textfold
from docveil.operators import audit, coreference, diff, evaluate, filters, gate, masking, matters, pages, rules, scan, vault
from docveil.operators.match import line_number, spans

BY_NAME = {r.name: r for r in rules.RULES}
COMMON = [BY_NAME[n] for n in ("email", "ip", "card")]
STANDARD = rules.of_profile("standart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def found(spark: SparkSession, sf_dir: str, chosen: list[rules.Rule] = COMMON) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("matter_id"), "text")
    return rules.exploded(rules.detect(docs, chosen), keep=("doc_id", "matter_id"))


def detect(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir, [BY_NAME[name]]).select("doc_id", "start", "end", "text", "score", "canonical")

    return query


#: DuckDB: (doc_id, matter_id, text, s, e, m) of every match of a pattern, places in code points.
def spans_sql(pattern: str, source: str = "documents", text: str = "text", more: str = "source AS matter_id") -> str:
    p = pattern.replace("'", "''")
    return f"""(SELECT doc_id, matter_id, full_text, m,
            (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS s,
            (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))::INT AS e
        FROM (SELECT doc_id, matter_id, full_text, g, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
              FROM (SELECT doc_id, {more}, {text} AS full_text, string_split_regex({text}, '{p}') AS g, regexp_extract_all({text}, '{p}') AS ms FROM {source})))"""


LUHN_SQL = """(length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN i % 2 = 0 THEN (2 * d[length(d) - i + 1]::INT) % 10 + (2 * d[length(d) - i + 1]::INT) // 10 ELSE d[length(d) - i + 1]::INT END)) % 10 = 0)"""
KEY_SQL = r"trim(regexp_replace(lower(translate(m, 'Iİ', 'ıi')), '[ \t\r\n\x0B\f]+', ' ', 'g'))"
DETECT_SQL = {
    "email": f"SELECT doc_id, matter_id, full_text, s, e, m, 100 AS score, 'EPOSTA' AS label_type, 'EPOSTA' AS entity, {KEY_SQL} AS canonical FROM {spans_sql(BY_NAME['email'].pattern)}",
    "ip": f"SELECT doc_id, matter_id, full_text, s, e, m, 60 AS score, 'IP' AS label_type, 'IP' AS entity, {KEY_SQL} AS canonical FROM {spans_sql('[0-9]+(?:[.][0-9]+)*')} WHERE regexp_full_match(m, '[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}') AND list_max(list_transform(string_split(m, '.'), lambda x: try_cast(x AS INT))) <= 255",
    "card": f"SELECT doc_id, matter_id, full_text, s, e, m, 100 AS score, 'KART' AS label_type, 'KART' AS entity, d AS canonical FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM {spans_sql(BY_NAME['card'].pattern)}) WHERE {LUHN_SQL}",
}
FOUND_SQL = " UNION ALL ".join(DETECT_SQL.values())
LABELS_SQL = f"""SELECT matter_id, label_type, canonical, row_number() OVER (PARTITION BY matter_id, label_type ORDER BY d, p, canonical)::INT AS number
    FROM (SELECT matter_id, label_type, canonical, min(doc_id) AS d, min(s) FILTER (WHERE doc_id = first_doc) AS p
          FROM (SELECT *, min(doc_id) OVER (PARTITION BY matter_id, label_type, canonical) AS first_doc FROM ({FOUND_SQL})) GROUP BY ALL)"""
SHOWN_SQL = "'{{' || label_type || '-' || CASE WHEN number < 10 THEN '0' || number ELSE number::VARCHAR END || '}}'"


def assign_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vault.number_values(found(spark, sf_dir))
    return labels.select("matter_id", "label_type", "canonical", "number", "label")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_documents(documents(spark, sf_dir), COMMON)
    return out.select("doc_id", "matter_id", "n_findings", F.sha2("masked", 256).alias("masked_sha256"))


MASK_SQL = f"""WITH f AS ({FOUND_SQL}), l AS ({LABELS_SQL}),
    x AS (SELECT f.doc_id, f.full_text, f.s, f.e, {SHOWN_SQL} AS label, coalesce(lag(f.e) OVER (PARTITION BY f.doc_id ORDER BY f.s), 0) AS before
          FROM f JOIN l USING (matter_id, label_type, canonical)),
    y AS (SELECT doc_id, string_agg(substr(full_text, before + 1, s - before) || label, '' ORDER BY s) || substr(any_value(full_text), max(e) + 1) AS masked, count(*) AS n FROM x GROUP BY doc_id)
    SELECT d.doc_id, d.source AS matter_id, coalesce(n, 0)::INT AS n_findings, sha256(coalesce(masked, text)) AS masked_sha256 FROM documents d LEFT JOIN y USING (doc_id)"""


def mask_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_documents(documents(spark, sf_dir), STANDARD)
    return out.select("doc_id", "matter_id", "n_findings", "n_suspects", F.sha2("masked", 256).alias("masked_sha256"))


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return masking.resolved(docs, STANDARD, once=True).select("doc_id", F.inline("suspects"))


def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return masking.resolved(docs, STANDARD, propagation=False, once=True).select("doc_id", F.inline("kept"))


def unmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents, with their labels damaged, read again: each value in its longest form."""
    docs = documents(spark, sf_dir)
    masked = masking.mask_documents(docs, COMMON)
    labels = vault.number_values(found(spark, sf_dir))
    damaged = masked.select("doc_id", "matter_id", F.regexp_replace("masked", r"\{\{([A-Z]+)-0*([0-9]+)\}\}", "{{ $1 - $2 }}").alias("text"))
    return vault.unmask(damaged, labels).select("doc_id", F.sha2("unmasked", 256).alias("unmasked_sha256"))


UNMASK_SQL = f"""WITH f AS ({FOUND_SQL}), v AS (SELECT matter_id, label_type, canonical, first(m ORDER BY length(m) DESC, m) AS main FROM f GROUP BY ALL),
    x AS (SELECT f.doc_id, f.full_text, f.s, f.e, main, coalesce(lag(f.e) OVER (PARTITION BY f.doc_id ORDER BY f.s), 0) AS before
          FROM f JOIN v USING (matter_id, label_type, canonical)),
    y AS (SELECT doc_id, string_agg(substr(full_text, before + 1, s - before) || main, '' ORDER BY s) || substr(any_value(full_text), max(e) + 1) AS unmasked FROM x GROUP BY doc_id)
    SELECT d.doc_id, sha256(coalesce(unmasked, text)) AS unmasked_sha256 FROM documents d LEFT JOIN y USING (doc_id)"""


def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in masked documents of all types but e-mails, read with a vault of e-mails only."""
    masked = masking.mask_documents(documents(spark, sf_dir), COMMON)
    labels = vault.number_values(found(spark, sf_dir, [BY_NAME["email"]]))
    return vault.unknown_labels(masked.select("doc_id", "matter_id", F.col("masked").alias("text")), labels)


UNKNOWN_SQL = f"SELECT DISTINCT f.doc_id, {SHOWN_SQL} AS label FROM ({FOUND_SQL}) f JOIN ({LABELS_SQL}) l USING (matter_id, label_type, canonical) WHERE label_type <> 'EPOSTA'"


def report_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.report(found(spark, sf_dir))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = rules.detect(docs, COMMON).select("doc_id", F.col("text").alias("whole"), F.inline("candidates"))
    return rows.select("doc_id", "start", "entity", line_number(F.col("whole"), F.col("start")).alias("line"))


#: What red_lines adds to documents, by doc_id.
PHRASES = ["Our defence strategy.", "Sent without prejudice; a settlement offer", "a trade secret\nand a Trade Secret", "medical history", "price-sensitive", "payslip", "nothing of note"]


def red_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one phrase more at its end, so that all categories occur."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), phrase).alias("text"))
    return scan.red_lines(docs).select("doc_id", "category", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "sample")


def cues_sql(cues: list[tuple[str, str]], source: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, s, e, m, length(substr(full_text, 1, s)) - length(replace(substr(full_text, 1, s), chr(10), '')) + 1 AS line FROM {spans_sql(p, source, text, 'doc_id AS matter_id')}" for c, p in cues)


PLANTED_SQL = f"(SELECT doc_id, coalesce(text, '') || chr(10) || {PHRASES}[(doc_id % {len(PHRASES)} + 1)::INT] AS text FROM documents)".replace("\\n", "' || chr(10) || '")
RED_SQL = f"""SELECT doc_id, category, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, arg_min(m, (s, e)) AS sample FROM ({cues_sql(scan.RED_LINES, PLANTED_SQL, 'text')}) GROUP BY ALL"""


def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.residual(documents(spark, sf_dir), "text")


#: DuckDB's patterns can't look around: wider matches, of which those that fit are taken by what stands before and after them.
RUNS_SQL = cues_sql([("11 digits", "[0-9]+"), ("10 digits", "[0-9]+"), ("iban", "TR ?[0-9]{2}(?: ?[0-9]{4}){2,}"), ("e-mail", dict(scan.RESIDUALS)["e-mail"]), ("mobile", "(?:[+]90|0) ?5[0-9]{2}")], "documents", "text")
RESIDUAL_SQL = f"""SELECT doc_id, category, line::INT AS line, count(*) AS n FROM (SELECT r.*, substr(text, s, 1) AS before, substr(text, e + 1, 2) AS after FROM ({RUNS_SQL}) r JOIN documents USING (doc_id))
    WHERE CASE category WHEN '11 digits' THEN length(m) = 11 AND m[1] <> '0'
        WHEN '10 digits' THEN (s = 0 OR NOT contains('/.,', before)) AND (length(m) = 11 OR length(m) = 10 AND NOT regexp_matches(after, '^[/.,][0-9]'))
        WHEN 'iban' THEN s = 0 OR NOT regexp_matches(before, '[A-Za-z0-9_]') WHEN 'mobile' THEN m[1] = '+' OR s = 0 OR NOT regexp_matches(before, '[A-Za-z0-9_]') ELSE true END GROUP BY ALL"""


def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "benchmark").select(F.col("text").alias("phrase"))
    return filters.dictionary_join(documents(spark, sf_dir), entries)


DICTIONARY_SQL = r"""SELECT doc_id, phrase, hits FROM (SELECT doc_id, phrase, list_sum(list_transform(range(1, len(p)), lambda i:
        (NOT (regexp_matches(q, '^[\p{L}\p{N}_]') AND regexp_matches(CASE WHEN i > 1 AND p[i] = '' THEN q ELSE p[i] END, '[\p{L}\p{N}_]$'))
        AND NOT (regexp_matches(q, '[\p{L}\p{N}_]$') AND regexp_matches(CASE WHEN i + 1 < len(p) AND p[i + 1] = '' THEN q ELSE p[i + 1] END, '^[\p{L}\p{N}_]')))::BIGINT))::BIGINT AS hits
    FROM (SELECT doc_id, phrase, lower(phrase) AS q, string_split(lower(text), lower(phrase)) AS p
        FROM documents JOIN (SELECT DISTINCT text AS phrase FROM benchmark WHERE trim(text) <> '') ON contains(lower(text), lower(phrase)))) WHERE hits > 0"""


def fold_tr_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.sha2(textfold.tr_lower(t), 256).alias("lower"), F.sha2(textfold.ascii_lower(t), 256).alias("plain"), F.sha2(textfold.key(t), 256).alias("key"))


FOLD_SQL = rf"""SELECT doc_id, sha256(lower(translate(text, 'Iİ', 'ıi'))) AS lower, sha256(translate(lower(translate(text, 'Iİ', 'ıi')), '{textfold.MARKED}', '{textfold.PLAIN}')) AS plain,
    sha256(trim(regexp_replace(lower(translate(text, 'Iİ', 'ıi')), '[ \t\r\n\x0B\f]+', ' ', 'g'))) AS key FROM documents"""


def luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = documents(spark, sf_dir).select("doc_id", F.inline(spans(F.col("text"), "[0-9]{12,19}")))
    return runs.select("doc_id", "start", "text", checks.luhn(F.col("text")).alias("valid"))


LUHN_RUNS_SQL = f"SELECT doc_id, s AS start, m AS text, {LUHN_SQL} AS valid FROM (SELECT *, m AS d FROM {spans_sql('[0-9]{12,19}')})"


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National and tax ids made of order keys, valid or not."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("1"), F.lpad((F.col("o_orderkey") * 7919 % 10_000_000_000).cast("string"), 10, "0")).alias("n"), F.lpad((F.col("o_orderkey") * 104_729 % 10_000_000_000).cast("string"), 10, "0").alias("t"))
    return rows.select("o_orderkey", checks.national_id(F.col("n")).alias("national_id"), checks.tax_id(F.col("t")).alias("tax_id"))


_N = [f"substr(n, {i}, 1)::INT" for i in range(1, 12)]
_T = " + ".join(f"(CASE WHEN ({m}) <> 0 AND (({m}) * {2 ** (9 - i)}) % 9 = 0 THEN 9 ELSE (({m}) * {2 ** (9 - i)}) % 9 END)" for i in range(9) for m in [f"(substr(t, {i + 1}, 1)::INT + {9 - i}) % 10"])
IDENTIFIERS_SQL = f"""SELECT o_orderkey,
    ((({_N[0]} + {_N[2]} + {_N[4]} + {_N[6]} + {_N[8]}) * 7 - ({_N[1]} + {_N[3]} + {_N[5]} + {_N[7]}) + 1000) % 10 = {_N[9]}
     AND ({' + '.join(_N[:10])}) % 10 = {_N[10]}) AS national_id,
    (10 - ({_T}) % 10) % 10 = substr(t, 10, 1)::INT AS tax_id
    FROM (SELECT o_orderkey, '1' || lpad((o_orderkey::HUGEINT * 7919 % 10000000000)::VARCHAR, 10, '0') AS n, lpad((o_orderkey::HUGEINT * 104729 % 10000000000)::VARCHAR, 10, '0') AS t FROM orders)"""


def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German account numbers made of customer keys, every hundredth of which has valid check digits by chance."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 7_919).cast("string"), 18, "0")).alias("i"))
    return rows.select("c_custkey", checks.iban(F.col("i")).alias("valid"))


IBAN_SQL = "SELECT c_custkey, (lpad((c_custkey * 7919)::VARCHAR, 18, '0') || '1314' || lpad((c_custkey % 97 + 2)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS valid FROM customer"


def lang_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", audit.language(F.col("text")).alias("language"))


def _lang_sql() -> str:
    languages = ("en", "fr", "de", "es")
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in audit.STOP_WORDS[n])}))) AS {n}" for n in languages)
    picks = " ".join(f"WHEN {n} = best AND {n} * 2 >= 3 * greatest({', '.join(m for m in languages if m != n)}, 0) THEN '{n}'" for n in sorted(languages))
    return f"""SELECT doc_id, CASE WHEN n < 3 OR best * 25 < n THEN NULL {picks} END AS language FROM
        (SELECT *, greatest(en, fr, de, es) AS best, len(w) AS n FROM
            (SELECT doc_id, w, {counts} FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents)))"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.paragraphs(documents(spark, sf_dir)).select("doc_id", "p_idx", "start", F.length("text").alias("size"))


PARAGRAPHS_SQL = """SELECT doc_id, (i - 1)::INT AS p_idx, (coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0))::INT AS start, length(p[i])::INT AS size
    FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(p[i], ' ') <> ''"""


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with Turkish and with English separators, read again."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    english = F.format_number(price, 2)
    turkish = F.translate(english, ",.", ".,")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", audit.number(english).cast("double").alias("english"), audit.number(turkish).cast("double").alias("turkish"))
    return rows


AMOUNT_SQL = "SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12, 2)::DOUBLE AS english, l_extendedprice::DECIMAL(12, 2)::DOUBLE AS turkish FROM lineitem"


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in three ways of writing, read again."""
    d = F.col("o_orderdate").cast("date")
    ways = {"iso": "yyyy-MM-dd", "dotted": "dd.MM.yyyy", "words": "d MMMM yyyy"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.date_format(audit.date(F.date_format(d, w)), "yyyyMMdd").alias(n) for n, w in ways.items()))


DATE_SQL = "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS iso, strftime(o_orderdate, '%Y%m%d') AS dotted, strftime(o_orderdate, '%Y%m%d') AS words FROM orders"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rules.detect(documents(spark, sf_dir).select("doc_id", "text"), COMMON)
    return pages.parts(docs, 2000, protected="candidates")


def turns_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return pages.paginate(items, 400, "conv_id", "turn", "size").select("conv_id", "turn", "page")


PAGED_SQL = """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    r AS (SELECT conv_id, turn, k, 1 AS page, n AS filled FROM o WHERE k = 1 UNION ALL
        SELECT o.conv_id, o.turn, o.k, CASE WHEN filled > 0 AND filled + n > 400 THEN page + 1 ELSE page END, CASE WHEN filled > 0 AND filled + n > 400 THEN n ELSE filled + n END
        FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
    SELECT conv_id, turn, page FROM r"""


def gate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of documents, looked for in the documents of their source as if these went out."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("out_id"), F.col("source").alias("matter_id"), "text")
    values = vault.number_values(found(spark, sf_dir)).select("matter_id", "label_type", "label", F.explode("values").alias("value"))
    return gate.gate(docs, values).select("out_id", "label_type", "label", "hits")


def gate_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_scan(spark, sf_dir).groupBy("label_type").agg(F.sum("hits").alias("hits"), F.count_distinct("out_id").alias("texts"))


def block_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as two versions, block by block."""
    rows = audit.paragraphs(documents(spark, sf_dir)).select("doc_id", F.expr("doc_id div 2").alias("pair_id"), F.col("p_idx").alias("block_idx"), "text")
    return diff.compare(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), marked=False).select("pair_id", "position", "kind", "old_block", "new_block")


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_counts(block_align(spark, sf_dir))


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails, addresses and cards as gold, against what all rules keep."""
    # COMMON are among STANDARD, so one scan finds both
    docs = masking.written(rules.detect(documents(spark, sf_dir).select("doc_id", "text"), STANDARD))
    gold = F.filter("candidates", lambda f: f["source"].isin([r.name for r in COMMON]))
    return evaluate.scores(masking.resolved(docs.withColumn("spans", F.transform(gold, lambda f: F.struct(f["start"], f["end"], f["label_type"]))), STANDARD))


def matter_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as matters: their documents, and those of them that have labels as answers."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("matter_id"), F.col("doc_id").alias("created"))
    return matters.overview(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"))


OVERVIEW_SQL = """SELECT d.source AS matter_id, count(DISTINCT d.doc_id) AS documents, count(l.doc_id) AS answers, max(d.doc_id) AS latest
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"""


def newest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created"), "event_type")
    return matters.newest(log, 200).select("id", "event_type")


def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("user_id") % 7).alias("hits"), F.length("props").alias("characters"))
    return matters.log_totals(log)


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities that even orders have more often than odd ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("quantity"))
    return matters.extra(rows.where("l_orderkey % 2 = 0").select("quantity"), rows.where("l_orderkey % 2 = 1").select("quantity"))


def plain_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word for another in every document, where it stands once."""
    docs = documents(spark, sf_dir)
    wanted = docs.select("doc_id", F.lit(" outre").alias("old"), F.lit(" neu").alias("new"), F.lit(False).alias("all"))
    return matters.revise(docs, wanted)


REVISION_SQL = """SELECT doc_id, ' outre' AS old, ' neu' AS new, CASE WHEN n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous' ELSE 'applied' END AS status
    FROM (SELECT doc_id, (length(text) - length(replace(text, ' outre', ''))) // 6 AS n FROM documents)"""


def label_coreference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of odd documents, looked up in a vault of the even ones."""
    every = found(spark, sf_dir)
    known = vault.number_values(every.where("doc_id % 2 = 0"))
    return coreference.known_labels(every.where("doc_id % 2 = 1"), known)


COREFERENCE_SQL = f"""SELECT DISTINCT matter_id, label_type, canonical, {SHOWN_SQL} AS label, 'exact' AS how FROM ({FOUND_SQL}) o
    JOIN (SELECT matter_id, label_type, canonical, row_number() OVER (PARTITION BY matter_id, label_type ORDER BY d, p, canonical) AS number
          FROM (SELECT matter_id, label_type, canonical, min(doc_id) AS d, min(s) FILTER (WHERE doc_id = first_doc) AS p
                FROM (SELECT *, min(doc_id) OVER (PARTITION BY matter_id, label_type, canonical) AS first_doc FROM ({FOUND_SQL}) WHERE doc_id % 2 = 0) GROUP BY ALL))
    USING (matter_id, label_type, canonical) WHERE o.doc_id % 2 = 1"""


QUERIES = {
    "mask_documents": (mask_documents, MASK_SQL),
    "mask_standard": (mask_standard, None),
    **{f"detect_{n}": (detect(n), f'SELECT doc_id, s AS start, e AS "end", m AS text, score, canonical FROM ({sql})') for n, sql in DETECT_SQL.items()},
    "overlap_resolve": (overlap_resolve, None),
    "suspects": (suspects, None),
    "assign_labels": (assign_labels, f"SELECT matter_id, label_type, canonical, number, {SHOWN_SQL} AS label FROM ({LABELS_SQL})"),
    "unmask": (unmask, UNMASK_SQL),
    "unknown_labels": (unknown_labels, UNKNOWN_SQL),
    "report_by_type": (report_by_type, f"SELECT label_type, count(*) AS n_findings, count(DISTINCT canonical) AS n_values, count(DISTINCT doc_id) AS n_docs FROM ({FOUND_SQL}) GROUP BY ALL"),
    "line_numbers": (line_numbers, f"SELECT doc_id, s AS start, entity, (length(substr(full_text, 1, s)) - length(replace(substr(full_text, 1, s), chr(10), '')) + 1)::INT AS line FROM ({FOUND_SQL})"),
    "red_lines": (red_lines, RED_SQL),
    "residual_scan": (residual_scan, RESIDUAL_SQL),
    "dictionary_match": (dictionary_match, DICTIONARY_SQL),
    "fold_tr_lower": (fold_tr_lower, FOLD_SQL),
    "luhn_valid": (luhn_valid, LUHN_RUNS_SQL),
    "identifiers": (identifiers, IDENTIFIERS_SQL),
    "iban_valid": (iban_valid, IBAN_SQL),
    "lang_guess": (lang_guess, _lang_sql()),
    "paragraphs": (paragraphs, PARAGRAPHS_SQL),
    "amount_parse": (amount_parse, AMOUNT_SQL),
    "date_parse": (date_parse, DATE_SQL),
    "protected_chunks": (chunks, None),
    "paginate_items": (turns_paged, PAGED_SQL),
    "gate_scan": (gate_scan, None),
    "gate_by_type": (gate_by_type, None),
    "block_align": (block_align, None),
    "change_counts": (change_counts, None),
    "leakage_recall": (leakage, None),
    "matter_overview": (matter_overview, OVERVIEW_SQL),
    "newest_log": (newest_log, "SELECT event_id AS id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)"),
    "log_totals": (log_totals, "SELECT event_type AS tool, count(*) AS calls, sum(user_id % 7)::BIGINT AS hits, sum(length(props))::BIGINT AS characters FROM events GROUP BY ALL"),
    "multiset_difference": (multiset_difference, "SELECT l_quantity::INT AS quantity FROM lineitem WHERE l_orderkey % 2 = 0 EXCEPT ALL SELECT l_quantity::INT FROM lineitem WHERE l_orderkey % 2 = 1"),
    "plain_revision": (plain_revision, REVISION_SQL),
    "label_coreference": (label_coreference, COREFERENCE_SQL),
}
