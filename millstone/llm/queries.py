"""Registered queries of the training-data operators, with oracles where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import functions as F

from millstone.llm import bpe_trie, chat, cover, decontam, jaccard, lm, mtree, suffix, tokens, toxicity, warc, wfst, whiten
from millstone.llm.common import read

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """A public tokenizer file: the installed package's place, else ``TOKENIZER_DIR``."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)


def op1_chat_format(spark, sf):
    c = chat.rotate(read(spark, sf, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return c.withColumn("mask", F.array_join(spans, ","))


def op2_interpolated_lm(spark, sf):
    return lm.interpolated_scores(read(spark, sf, "documents"))


def op3_suffix_dedup(spark, sf):
    return suffix.repeated_spans(read(spark, sf, "documents")).drop("spans")


def op4_toxicity(spark, sf):
    return toxicity.toxicity_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op5_decontaminate(spark, sf):
    return decontam.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op6_jaccard_join(spark, sf):
    return jaccard.similar_classes(read(spark, sf, "documents")).drop("set_id")


def op7_sentencepiece(spark, sf):
    return wfst.encode_documents(read(spark, sf, "documents"), vocabulary(PIECE_BPE))


def op8_token_counts(spark, sf):
    return tokens.token_counts(read(spark, sf, "documents"), vocabulary(BYTE_BPE))


def op9_mtree_topk(spark, sf):
    return mtree.top_k(read(spark, sf, "embeddings"))


def op10_warc(spark, sf):
    return warc.write_and_read(read(spark, sf, "pages")).drop("digest_ok")


def op11_bpe_trie(spark, sf):
    coded = bpe_trie.encode_documents(read(spark, sf, "documents"), vocabulary(BYTE_BPE))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover.hard_negatives(read(spark, sf, "embeddings").withColumn("label", moved))


def op13_whitening(spark, sf):
    return whiten.whiten(read(spark, sf, "embeddings"))


ORACLES = {
    "op1_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 128 AS BIGINT) AS part
  FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
m AS (
  SELECT t.conv_id, perspective, part, turn, speaker, text,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                ELSE 'user name=' || speaker END || chr(10) AS head,
         speaker = perspective AS own
  FROM t JOIN views ON t.conv_id = views.conv_id),
n AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, part
              ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS BIGINT) AS begins
  FROM m)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_assistant,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, speaker, text) AS text,
       coalesce(string_agg(CASE WHEN own THEN begins || '-' || (begins + length(text)) END, ',' ORDER BY turn, speaker, text), '') AS mask
FROM n GROUP BY conv_id, perspective, part""",
    "op9_mtree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.vec_id, s.score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
   AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5""",
    "op10_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest IS NOT NULL AND newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest <> page_id THEN newest END AS refers_to FROM g""",
}


def queries() -> dict[str, Callable]:
    own = [op1_chat_format, op2_interpolated_lm, op3_suffix_dedup, op4_toxicity, op5_decontaminate, op6_jaccard_join,
           op7_sentencepiece, op8_token_counts, op9_mtree_topk, op10_warc, op11_bpe_trie, op12_hard_negatives, op13_whitening]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
