"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, circulant, decontaminate, html, licenses, minhash, negatives, pack, quality, simhash, tokens, warc, whitening
from tessella.llm.common import table

#: Words a shingle in op1's contract.
OP1_SHINGLE = 4


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=OP1_SHINGLE)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _op2_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = minhash.clusters(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"))
    return sized.withColumnRenamed("words", "size")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(_op2_sized(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.findings(table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(table(spark, sf_dir, "documents"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p : p + 4], ' ')))) END AS s FROM w
), c AS (
    SELECT row_number() OVER () AS cid, s, min(doc_id) AS first_id FROM s GROUP BY s
), x AS (
    SELECT cid, len(s) AS n, unnest(s) AS g FROM c
), e AS (
    SELECT a.cid AS u, b.cid AS v FROM x AS a JOIN x AS b ON a.g = b.g AND a.cid <> b.cid GROUP BY a.cid, b.cid, a.n, b.n
    HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.8
), r AS (
    SELECT cid, cid AS other FROM c UNION SELECT r.cid, e.v FROM r JOIN e ON r.other = e.u
), k AS (
    SELECT r.cid, min(c.first_id) AS component_id FROM r JOIN c ON c.cid = r.other GROUP BY r.cid
)
SELECT s.doc_id, component_id, (SELECT count(*) FROM e WHERE e.u = c.cid)::BIGINT AS n_links FROM s JOIN c ON c.s = s.s JOIN k ON k.cid = c.cid
"""


def packing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has in the bins of op2, and how much of it is right by each rule."""
    return pack.audit(pack.pack(_op2_sized(spark, sf_dir), conflicts=True))


#: Every piece of a source must be right by each rule, so each count is the number of pieces.
AUDIT_SQL = r"""
SELECT source, pieces, words, pieces AS apart_by_source, pieces AS apart_by_cluster, pieces AS fitting
FROM (SELECT source, sum(greatest(ceil(n / 2048.0), 1))::BIGINT AS pieces, sum(n)::BIGINT AS words
      FROM (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents) GROUP BY source)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS t, least(len(w), 10) AS size
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p)
    WHERE len(w) > 0
), spot AS (
    SELECT rid, p, size, array_to_string(w[p : p + size - 1], ' ') AS t
    FROM d, (SELECT DISTINCT size FROM win) AS s, unnest(range(1, len(w) - size + 2)) AS u(p)
), hit AS (
    SELECT rid, p, size, item_id FROM spot JOIN win USING (size, t)
), covered AS (
    SELECT rid, count(DISTINCT k) AS n_hit
    FROM (SELECT DISTINCT rid, p, size FROM hit) AS h, unnest(range(p, p + size)) AS u(k)
    GROUP BY rid
), items AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages
), b AS (
    SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first_id,
           list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (5 * k + 1)::INT, 5))::BIGINT) AS parts
    FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v: concat(
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768 % 32 + 1)::INT, 1),
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024 % 32 + 1)::INT, 1),
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32 % 32 + 1)::INT, 1),
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v % 32 + 1)::INT, 1))), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
    SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
           md5(string_agg(concat(role, chr(1), text), chr(2)) OVER w) AS h
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), whole AS (
    SELECT min(conv_id) AS conv_id, n, h, count(*) AS n_copies FROM p WHERE k = n GROUP BY n, h
), stay AS (
    SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = whole.n AND p.h = whole.h)
)
SELECT conv_id, any_value(n)::BIGINT AS n_turns, any_value(n_copies)::BIGINT AS n_copies,
       string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>'), chr(10) ORDER BY turn, role, text) AS text
FROM t JOIN stay USING (conv_id) GROUP BY conv_id
"""


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", negatives.moved_label(vec_id, F.col("label")).alias("label"), "embedding")
    return negatives.hard_negatives(rows, vec_id % 100 == 0)


OP11_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
    FROM s WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> p.anchor_label
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda p: array_to_string(w[p : p + 3], ' ')))) END AS s FROM w
), c AS (
    SELECT row_number() OVER () AS cid, s, min(doc_id) AS first_id FROM s WHERE len(s) > 0 GROUP BY s
), x AS (
    SELECT cid, len(s) AS n, unnest(s) AS g FROM c
), e AS (
    SELECT a.cid AS u, b.cid AS v FROM x AS a JOIN x AS b ON a.g = b.g AND a.cid <> b.cid GROUP BY a.cid, b.cid, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
    SELECT cid, cid AS other FROM c UNION SELECT r.cid, e.v FROM r JOIN e ON r.other = e.u
), k AS (
    SELECT r.cid, min(c.first_id) AS component_id FROM r JOIN c ON c.cid = r.other GROUP BY r.cid
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id,
       s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.cid = c.cid
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_tokens": op4_tokens,
    "op5_minhash": op5_minhash,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_chat": op10_chat,
    "op11_negatives": op11_negatives,
    "op12_whitening": op12_whitening,
    "op13_circulant": op13_circulant,
    "minhash_near_duplicates": minhash_near_duplicates,
    "packing_audit": packing_audit,
}

ORACLES: dict[str, str] = {
    "minhash_near_duplicates": NEAR_SQL,
    "packing_audit": AUDIT_SQL,
    "op6_decontamination": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op10_chat": OP10_SQL,
    "op11_negatives": OP11_SQL,
    "op13_circulant": OP13_SQL,
}
