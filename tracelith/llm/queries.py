"""The queries ``opN_<name>`` of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, licenses, minhash, packing, secrets, simhash, topk, toxicity, warc
from .common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), wrapped=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprinted(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(chat.probe(spark)))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _licenses_sql() -> str:
    """Brute force: every line against every template, every word against every phrase."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = [(p.split(), label) for p, label in licenses.BASE.items()]
    at = " || ".join("list_transform(list_filter(range(len(ws)), lambda i: " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p)) + f"), lambda i: {{'pos': i, 'label': '{label}'}})" for p, label in phrases)
    values = ", ".join(f"('{k}', {sorted({w.decode() for w in licenses.words_of(t)})})" for k, t in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
p AS (SELECT doc_id, t, ws, {at} AS hits FROM w),
l AS (SELECT DISTINCT doc_id, i, list_distinct(regexp_extract_all(line, '{word}')) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
m AS (SELECT doc_id, i, label, len(list_intersect(b, tokens)) / len(tokens) AS share FROM l, (VALUES {values}) AS templates(label, tokens)
      WHERE len(list_intersect(b, tokens)) >= ceil(round({licenses.THRESHOLD} * len(tokens), 9))),
b AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best, count(DISTINCT i) AS n_blocks FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base,
  list_min(list_transform(hits, lambda x: x.pos)) AS first_word, list_max(list_transform(hits, lambda x: x.pos)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label) || coalesce(labels, []))), ','), '') AS labels,
  CAST(greatest(CASE WHEN len(hits) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS DOUBLE) AS score, coalesce(n_blocks, 0) AS n_blocks
FROM p LEFT JOIN b USING (doc_id)"""


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

_CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body,
             replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;') AS mark FROM c)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] THEN 'prompt-system'
  WHEN roles[1] = 'user' AND len(list_filter(roles, lambda r: r NOT IN ('user', 'assistant', 'system'))) = 0 THEN 'conversations' ELSE 'messages' END AS layout
FROM (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(mark) + length(body) + 8) AS BIGINT) AS formatted_chars, list(role ORDER BY turn NULLS FIRST, role, text) AS roles FROM f GROUP BY conv_id)"""


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to FROM h"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": _WARC_SQL, "op1_licenses": _licenses_sql(), "op4_topk": _TOPK_SQL, "op5_chat": _CHAT_SQL}
