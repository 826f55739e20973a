"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from docveil.llm import bpe, chat, collocations, digest, hamerly, html, langid, ogg, packing, paritysketch, suffixdedup, urls, warc


def queries():
    return {
        "op1_site_templates": html.op1,
        "op2_histogram_packing": packing.op2,
        "op3_induced_suffixes": suffixdedup.op3,
        "op4_path_templates": urls.op4,
        "op5_parity_join": paritysketch.op5,
        "op6_ogg_media": ogg.op6,
        "op7_improbable_features": digest.op7,
        "op8_code_langid": langid.op8,
        "op9_warc_chunks": warc.op9,
        "op10_byte_bpe": bpe.op10,
        "op11_hamerly_clusters": hamerly.op11,
        "op12_bitmap_collocations": collocations.op12,
        "op13_chat_template": chat.op13,
    }


BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {b}) & 31) + 1, 1)" for g in range(8) for b in (15, 10, 5, 0))
WARC_SQL = f"""SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
        CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
    FROM (SELECT *, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS f FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))"""

JACCARD_SQL = r"""WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, d.component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY ALL) d LEFT JOIN n USING (doc_id)"""


def oracle_sql():
    return {"op4_path_templates": urls.oracle(), "op5_parity_join": JACCARD_SQL, "op9_warc_chunks": WARC_SQL, "op11_hamerly_clusters": hamerly.SQL, "op12_bitmap_collocations": collocations.SQL, "op13_chat_template": chat.SQL}
