"""The registered queries of the training-data operators and their oracle SQL.

Each query applies its operator, with production parameters, to the whole of
its table and derives short digest columns from the operator's real output.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, lattice_lm, line_dedup, packing, piece_model, pu_classifier, quality_rules, simhash,
               token_alignment, topk, toxicity, url_filter, warc)
from .common import fold, save, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


@query(r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL) d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    decoded = piece_model.decode(piece_model.encode(docs, PIECES), PIECES)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32",
                          F.sha2("text", 256).alias("decoded_sha256"), "parity")


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_bytes(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=0)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query()
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page and the document made of it share an id, so the documents' quality labels mark the pages.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


@query(r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages WHERE page_id IS NOT NULL)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       translate(to_base(CAST('0x' || substr(sha1(payload), 1, 10) AS BIGINT), 32, 8)
              || to_base(CAST('0x' || substr(sha1(payload), 11, 10) AS BIGINT), 32, 8)
              || to_base(CAST('0x' || substr(sha1(payload), 21, 10) AS BIGINT), 32, 8)
              || to_base(CAST('0x' || substr(sha1(payload), 31, 10) AS BIGINT), 32, 8),
              '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_back(spark, path)


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice_lm.score_documents(table(spark, sf_dir, "documents"), PIECES, train=fold(F.col("doc_id")) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score", "lattice_score")


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = save(quality_rules.measure(docs).drop("text"))
    return quality_rules.judge(measured, table(spark, sf_dir, "labels")).select("doc_id", *quality_rules.BASE, "kept")


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = pu_classifier.classify(docs, labels, train=fold(F.col("doc_id")) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.classify(docs, labels, train=fold(F.col("doc_id")) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@query()
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


@query(r"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
           lambda c: list_transform(range(8), lambda b: (ord(c) >> b) & 1)))),
           lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))) AS crc
  FROM conversations WHERE conv_id IS NOT NULL),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, xor(crc, 4294967295) % 20 AS how FROM plain) WHERE how <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, lead(role) OVER w AS next_role,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faulty AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                 WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
report AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE left(role, 1) || left(next_role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id),
edge(a, token, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
name(token, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
given AS (
  SELECT a, 0 AS a0, a AS b, 0 AS cost, '' AS audit, '' AS lines FROM (SELECT unnest(range(4)) AS a)
  UNION ALL SELECT a, 0, b, 5, 'I', chr(10) || role || ':' FROM edge JOIN name USING (token)
  UNION ALL SELECT e.a, 0, f.b, 10, 'II', chr(10) || m.role || ':' || chr(10) || n.role || ':'
  FROM edge e JOIN name m ON m.token = e.token JOIN edge f ON f.a = e.b JOIN name n ON n.token = f.token),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM report
  UNION ALL
  SELECT conv_id, i, state, min(best) AS best FROM (
    SELECT p.conv_id, p.i + 1 AS i, m.b AS state,
           {'cost': p.best.cost + g.cost + m.cost, 'audit': p.best.audit || g.audit || m.audit,
            'lines': p.best.lines || g.lines || CASE WHEN m.audit = 'D' THEN '' ELSE chr(10) || coalesce(m.role, f.role) || ':' || f.text END}
             AS best
    FROM path p JOIN faulty f ON f.conv_id = p.conv_id AND f.i = p.i + 1 JOIN given g ON g.a = p.state
    JOIN (SELECT a, b, token, 0 AS cost, 'K' AS audit, NULL AS role FROM edge
          UNION ALL SELECT a, b, NULL, 1, 'R', role FROM edge JOIN name USING (token)
          UNION ALL SELECT a, a, NULL, 2, 'D', NULL FROM (SELECT unnest(range(4)) AS a)) k ON k.a = g.b
    JOIN (SELECT 0 AS truncated UNION ALL SELECT 1) t ON t.truncated = CAST(f.fault = 'truncated' AND k.audit <> 'D' AS INTEGER),
    LATERAL (SELECT k.b, k.cost + 5 * t.truncated AS cost, k.audit, k.role) m
    WHERE (k.audit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (k.token IS NULL OR k.token = left(f.role, 1))) x
  GROUP BY conv_id, i, state),
done AS (
  SELECT p.conv_id, min({'cost': p.best.cost + g.cost, 'audit': p.best.audit || g.audit, 'lines': p.best.lines || g.lines}) AS best
  FROM path p JOIN report r ON r.conv_id = p.conv_id AND r.n = p.i JOIN given g ON g.a = p.state
  WHERE g.b IN (0, 3) GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(d.best.cost, 0) AS cost,
       coalesce(d.best.audit, '') AS audit, sha256(coalesce(substr(d.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c
LEFT JOIN report r ON r.conv_id = c.conv_id LEFT JOIN done d ON d.conv_id = c.conv_id""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(rows)))
    ids = rows.where("conv_id is not null").select("conv_id").distinct()
    filled = ids.join(found, "conv_id", "left").fillna(0, conversation_repair.COUNTS)
    return filled.fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
