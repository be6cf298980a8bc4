"""The thin opN queries over whole tables, and their DuckDB SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import contamination, langid, licences, near, pieces, quality, repeats, shards, toxicity, urls

N_SHARDS = 40
#: Where the public tokenizer files lie; a parameter, never copied here.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.spam_list(pages))


def op3_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op6_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * N_SHARDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perplexity_bands": op1_perplexity_bands,
    "op2_url_filter": op2_url_filter,
    "op3_byte_network_language": op3_byte_network_language,
    "op4_qgram_leaks": op4_qgram_leaks,
    "op5_licence_paragraphs": op5_licence_paragraphs,
    "op6_piece_ids": op6_piece_ids,
    "op7_suffix_array_repeats": op7_suffix_array_repeats,
    "op8_jaccard_tiles": op8_jaccard_tiles,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_rendezvous_shards": op10_rendezvous_shards,
}

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = rf"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), ''), {_ASCII}) AS host,
         coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html|/+)$', '') AS canon FROM u
), spam AS (
  SELECT DISTINCT canon FROM c WHERE list_contains(string_split(host, '.'), 'spam-farm')
), ruled AS (
  SELECT page_id, host, path, canon,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN spam.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       spam.canon IS NOT NULL AS listed
FROM ruled LEFT JOIN spam USING (canon)
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ASCII}), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w
), s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * k >= 70 * (na + nb - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1),
q AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY 1)
SELECT g.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, CAST(coalesce(q.n, 0) AS BIGINT) AS n_similar, component_id,
       CASE WHEN len(g) = 0 THEN g.doc_id ELSE min(g.doc_id) OVER (PARTITION BY g) END AS class_id
FROM g JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)
"""

def _crc_table() -> str:
    """The byte table of CRC-32 as a SQL list."""
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(str(c))
    return "[" + ", ".join(out) + "]"


def _best(n: int) -> str:
    draws = ", ".join(f"{{'d': substr(md5(k || '#{i}'), 1, 13), 's': {-i}}}" for i in range(n))
    return f"-list_max([{draws}]).s"


OP10_SQL = f"""
WITH t AS (SELECT {_crc_table()} AS t), b AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, k, size, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
         lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM b, t
), s AS (SELECT *, CAST({_best(N_SHARDS)} AS INTEGER) AS shard, CAST({_best(N_SHARDS + 1)} AS INTEGER) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || ':' || text_crc32), 1, 3), doc_id, text_crc32, size) - 1 AS slot
FROM s
"""

ORACLE: dict[str, str] = {"op2_url_filter": OP2_SQL, "op8_jaccard_tiles": OP8_SQL, "op10_rendezvous_shards": OP10_SQL}
