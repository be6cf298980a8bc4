"""Registered queries of the archive engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import predicates as P
from palimpsest.functions import text as X
from palimpsest.functions import timestamps as D
from palimpsest.functions import urls as U
from palimpsest.functions.rewrite import headers as H
from palimpsest.functions.rewrite import text as R
from palimpsest.operators import adblock, blocks, listing, lookup, stats, store
from palimpsest.plans.views import CAPS, CAPTURE_COLUMNS, REQS, SKIP, SKIP5, caps, reqs
from palimpsest.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PREFIX = "https://replay.example/coll/20200101000000mp_/"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@register(f"""WITH {CAPS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts_ms DESC) AS n FROM caps WHERE NOT {SKIP})
SELECT url, ts_ms, event_id, status, mime, digest, page_id FROM r WHERE n = 1""")
def latest_capture_per_url(spark, d):
    return lookup.latest(caps(spark, d), [c for c in CAPTURE_COLUMNS if c != "ts_ms"])


@register(f"WITH {CAPS} SELECT event_id, url, ts_ms, status FROM caps WHERE url = 'https://u1.example.com/view'")
def exact_range(spark, d):
    return listing.exact(caps(spark, d), "https://u1.example.com/view").select("event_id", "url", "ts_ms", "status")


@register(f"WITH {CAPS} SELECT event_id, url, ts_ms, status FROM caps WHERE starts_with(url, 'https://u1')")
def prefix_range(spark, d):
    return listing.prefix(caps(spark, d), "https://u1").select("event_id", "url", "ts_ms", "status")


@register(f"WITH {CAPS} SELECT event_id, url, ts_ms, status FROM caps WHERE starts_with(url, 'https://u2.example.com/')")
def host_range(spark, d):
    return listing.host(caps(spark, d), "https://u2.example.com").select("event_id", "url", "ts_ms", "status")


@register(f"""WITH {CAPS} SELECT event_id, url, ts_ms, mime FROM caps
WHERE (url > 'https://u1.example.com/click' OR (url = 'https://u1.example.com/click' AND ts_ms > 1704500000000))
  AND (starts_with(mime, 'text/') OR starts_with(mime, 'image/png')) ORDER BY url, ts_ms LIMIT 100""")
def url_page_keyset(spark, d):
    c = caps(spark, d)
    return listing.url_page(c, c, "text/,image/png", 100, "https://u1.example.com/click", 1704500000000).select("event_id", "url", "ts_ms", "mime")


@register(f"""WITH {CAPS} SELECT mime, status, url, ts_ms FROM caps WHERE starts_with(mime, 'text/')
  AND (mime > 'text/css' OR (mime = 'text/css' AND (status > 200 OR (status = 200 AND url > 'https://u2'))))
ORDER BY mime, status, url, ts_ms LIMIT 100""")
def mime_page_keyset(spark, d):
    return listing.mime_page(caps(spark, d), "text/", 100, "text/css", 200, "https://u2").select("mime", "status", "url", "ts_ms")


@register(f"""WITH {CAPS} SELECT url, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS date,
  strftime(make_timestamp(ts_ms * 1000), '%Y%m%d%H%M%S') AS ts, coalesce(mime, '') AS mime, coalesce(status, 0) AS status FROM caps""")
def result_projection(spark, d):
    return listing.result_row(caps(spark, d))


@register(f"WITH {CAPS} SELECT ts_ms FROM caps WHERE url = 'https://u3.example.com/view'")
def timestamps_of_url(spark, d):
    return listing.timestamps_of(caps(spark, d), "https://u3.example.com/view")


@register(f"WITH {CAPS} SELECT event_id, url, page_id FROM caps WHERE page_id IN (SELECT event_id FROM caps WHERE status = 503)")
def captures_of_pages(spark, d):
    c = caps(spark, d)
    wanted = c.where("status = 503").select(F.col("event_id").alias("page_id"))
    return listing.of_pages(c, wanted).select("event_id", "url", "page_id")


@register(f"WITH {CAPS} SELECT event_id, url FROM caps WHERE url IN (SELECT url FROM caps WHERE status = 404)")
def match_any_exact(spark, d):
    c = caps(spark, d)
    return listing.match_any(c, "url", c.where("status = 404").select("url")).select("event_id", "url")


@register(f"""WITH {CAPS} SELECT event_id, url FROM caps c WHERE EXISTS (
  SELECT 1 FROM (SELECT DISTINCT 'https://u' || (o_custkey % 40) || '.' AS p FROM orders) k WHERE starts_with(c.url, k.p))""")
def match_any_prefix(spark, d):
    keys = table(spark, d, "orders").select(F.expr("concat('https://u', o_custkey % 40, '.')").alias("p"))
    return listing.match_any(caps(spark, d), "url", keys, as_prefix=True).select("event_id", "url")


def _hit(df: DataFrame) -> DataFrame:
    return df.select("req_id", F.col("hit.event_id").alias("event_id"), F.col("hit.ts_ms").alias("hit_ts_ms"))


@register(f"""WITH {REQS} SELECT r.req_id, c.event_id, c.ts_ms AS hit_ts_ms
FROM reqs r ASOF LEFT JOIN caps c ON r.url = c.url AND r.ts_ms <= c.ts_ms""")
def asof_forward(spark, d):
    rows = lookup.union_rows(reqs(spark, d), caps(spark, d), CAPTURE_COLUMNS[1:] + ["event_id"], F.lit(False))
    rows = lookup.carry(rows, "_key", "_t", "_cap", "hit", forward=True).where("_req is not null")
    return _hit(rows.select("_req.*", "hit"))


@register(f"""WITH {REQS} SELECT r.req_id, c.event_id, c.ts_ms AS hit_ts_ms
FROM reqs r ASOF LEFT JOIN caps c ON r.url = c.url AND r.ts_ms >= c.ts_ms""")
def asof_backward(spark, d):
    rows = lookup.union_rows(reqs(spark, d), caps(spark, d), CAPTURE_COLUMNS[1:] + ["event_id"], F.lit(False))
    rows = lookup.carry(rows, "_key", "_t", "_cap", "hit").where("_req is not null")
    return _hit(rows.select("_req.*", "hit"))


def _plain_sql(skip: str) -> str:
    """Forward row first; if it is skipped, the newest other one up to ten seconds on; else the newest before."""
    return f"""WITH {REQS}, f AS (
  SELECT r.req_id, r.url, r.ts_ms, c.event_id AS fid, c.ts_ms AS fts, coalesce(c.skip, false) AS fskip
  FROM reqs r ASOF LEFT JOIN (SELECT *, {skip} AS skip FROM caps) c ON r.url = c.url AND r.ts_ms <= c.ts_ms
), b AS (
  SELECT f.*, f.ts_ms + CASE WHEN f.fid IS NOT NULL AND f.fskip THEN 10000 ELSE 0 END AS probe FROM f
), g AS (
  SELECT b.*, c.event_id AS bid, c.ts_ms AS bts FROM b ASOF LEFT JOIN (SELECT * FROM caps WHERE NOT coalesce({skip}, false)) c ON b.url = c.url AND b.probe >= c.ts_ms
)
SELECT req_id, CASE WHEN fid IS NOT NULL AND NOT fskip THEN fid ELSE bid END AS event_id,
       CASE WHEN fid IS NOT NULL AND NOT fskip THEN fts ELSE bts END AS hit_ts_ms FROM g"""


@register(_plain_sql("false"))
def asof_preferred(spark, d):
    free = caps(spark, d).withColumn("status", F.lit(200))
    return _hit(lookup.lookup(reqs(spark, d), free, CAPTURE_COLUMNS))


@register(_plain_sql(SKIP))
def asof_skip_self_redirect(spark, d):
    return _hit(lookup.lookup(reqs(spark, d), caps(spark, d), CAPTURE_COLUMNS))


@register(_plain_sql(SKIP5))
def asof_skip_5xx(spark, d):
    return _hit(lookup.lookup(reqs(spark, d), caps(spark, d), CAPTURE_COLUMNS, lookup.Options(skip5xx=True)))


def _filtered_sql(drop: str) -> str:
    return f"""WITH {REQS}, n AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts_ms) AS o, coalesce({drop}, false) AS dropped FROM caps
), f AS (
  SELECT r.req_id, r.url, r.ts_ms, c.o FROM reqs r ASOF LEFT JOIN n c ON r.url = c.url AND r.ts_ms <= c.ts_ms
), s AS (
  SELECT f.req_id, f.url, f.ts_ms, f.o AS o0, c.o AS o1, c.event_id AS fid, c.ts_ms AS fts
  FROM f ASOF LEFT JOIN (SELECT * FROM n WHERE NOT dropped) c ON f.url = c.url AND f.ts_ms <= c.ts_ms
), b AS (
  SELECT s.*, c.event_id AS bid, c.ts_ms AS bts
  FROM s ASOF LEFT JOIN (SELECT * FROM n WHERE NOT dropped) c ON s.url = c.url AND s.ts_ms >= c.ts_ms
)
SELECT req_id, CASE WHEN o1 - o0 < 16 THEN fid ELSE bid END AS event_id, CASE WHEN o1 - o0 < 16 THEN fts ELSE bts END AS hit_ts_ms FROM b"""


@register(_filtered_sql(f"mime = 'warc/revisit' OR {SKIP}"))
def asof_no_revisits(spark, d):
    return _hit(lookup.lookup(reqs(spark, d), caps(spark, d), CAPTURE_COLUMNS, lookup.Options(no_revisits=True)))


@register(_filtered_sql(f"bucket <> 3 OR {SKIP}").replace("FROM caps\n), f", "FROM (SELECT *, page_id % 8 AS bucket FROM caps)\n), f"))
def asof_page_scoped(spark, d):
    """Captures of one page group only; page ids are folded to eight so that all cases occur."""
    c = caps(spark, d).withColumn("page_id", F.expr("page_id % 8"))
    return _hit(lookup.lookup(reqs(spark, d), c, CAPTURE_COLUMNS, lookup.Options(page_id=3)))


@register(f"""WITH {REQS}, a AS (
  SELECT r.req_id, r.url, r.ts_ms, c.event_id AS bid, c.ts_ms AS bts FROM reqs r ASOF LEFT JOIN caps c ON r.url = c.url AND r.ts_ms >= c.ts_ms
), b AS (
  SELECT a.*, c.event_id AS fid, c.ts_ms AS fts FROM a ASOF LEFT JOIN caps c ON a.url = c.url AND a.ts_ms <= c.ts_ms
)
SELECT req_id, CASE WHEN fid IS NULL OR ts_ms - bts <= fts - ts_ms THEN bid ELSE fid END AS event_id,
       CASE WHEN fid IS NULL OR ts_ms - bts <= fts - ts_ms THEN bts ELSE fts END AS hit_ts_ms FROM b""")
def nearest_capture(spark, d):
    return _hit(lookup.nearest(reqs(spark, d), caps(spark, d), CAPTURE_COLUMNS))


@register(f"""WITH {REQS}, p AS (SELECT * FROM caps WHERE status = 200 AND mime = 'text/html'), a AS (
  SELECT r.req_id, r.url, r.ts_ms, c.page_id AS bid, c.ts_ms AS bts FROM reqs r ASOF LEFT JOIN p c ON r.url = c.url AND r.ts_ms >= c.ts_ms
), b AS (
  SELECT a.*, c.page_id AS fid, c.ts_ms AS fts FROM a ASOF LEFT JOIN p c ON a.url = c.url AND a.ts_ms <= c.ts_ms
)
SELECT req_id, CASE WHEN fid IS NULL OR ts_ms - bts <= fts - ts_ms THEN bid ELSE fid END AS page_id FROM b""")
def nearest_page(spark, d):
    pages = caps(spark, d).where("status = 200 and mime = 'text/html'")
    return lookup.nearest(reqs(spark, d), pages, CAPTURE_COLUMNS).select("req_id", F.col("hit.page_id").alias("page_id"))


@register(f"""WITH {REQS}, c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'http:' || url[7:] ELSE url END AS url, ts_ms FROM caps),
t AS (
  SELECT req_id, 'http:' || url[7:] AS asked, ts_ms, 0 AS rank, 'http:' || url[7:] AS url FROM reqs UNION ALL
  SELECT req_id, 'http:' || url[7:], ts_ms, 1, url FROM reqs
), f AS (SELECT t.*, c.event_id AS fid FROM t ASOF LEFT JOIN c ON t.url = c.url AND t.ts_ms <= c.ts_ms),
b AS (SELECT f.*, c.event_id AS bid FROM f ASOF LEFT JOIN c ON f.url = c.url AND f.ts_ms >= c.ts_ms),
h AS (SELECT req_id, asked, rank, url, coalesce(fid, bid) AS hid FROM b)
SELECT req_id, any_value(asked) AS asked, arg_min(url, rank) FILTER (hid IS NOT NULL) AS url, arg_min(hid, rank) FILTER (hid IS NOT NULL) AS event_id FROM h GROUP BY req_id""")
def scheme_fallback(spark, d):
    plain = lambda c: F.concat(F.lit("http:"), F.substring(c, 7, 1 << 20))
    c = caps(spark, d).withColumns({"url": F.when(F.expr("event_id % 3 = 0"), plain(F.col("url"))).otherwise(F.col("url")), "status": F.lit(200)})
    found = lookup.with_scheme_fallback(reqs(spark, d).withColumn("url", plain(F.col("url"))), c, CAPTURE_COLUMNS, "req_id")
    return found.select("req_id", "asked", "url", F.col("hit.event_id").alias("event_id"))


@register(f"""WITH {CAPS}, o AS (SELECT * FROM caps WHERE mime <> 'warc/revisit' AND NOT {SKIP}),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts_ms) AS ord FROM caps),
v AS (SELECT n.event_id, n.url, n.ts_ms, n.ord FROM n WHERE mime = 'warc/revisit'),
f AS (SELECT v.*, c.event_id AS fid, c.ts_ms AS fts FROM v ASOF LEFT JOIN o c ON v.url = c.url AND v.ts_ms <= c.ts_ms),
g AS (SELECT f.*, n.ord AS ford FROM f LEFT JOIN n ON f.fid = n.event_id),
b AS (SELECT g.*, c.event_id AS bid FROM g ASOF LEFT JOIN o c ON g.url = c.url AND g.ts_ms >= c.ts_ms)
SELECT event_id, CASE WHEN ford - ord < 16 THEN fid ELSE bid END AS original_id FROM b""")
def revisit_resolved(spark, d):
    c = caps(spark, d).withColumns({"orig_url": F.lit(None).cast("string"), "orig_ts_ms": F.lit(None).cast("long")})
    return lookup.resolve_revisits(c, CAPTURE_COLUMNS, depth=1).select("event_id", F.col("hit.event_id").alias("original_id"))


@register(f"""WITH {CAPS}, two AS (
  SELECT event_id, url, ts_ms // 3600000 AS ts_ms, mime, status FROM caps
), r AS (SELECT *, row_number() OVER (PARTITION BY url, ts_ms ORDER BY
  CASE WHEN mime = 'warc/revisit' THEN 2 WHEN status >= 300 THEN 1 ELSE 0 END, event_id DESC) AS n FROM two)
SELECT url, ts_ms, event_id, mime, status FROM r WHERE n = 1""")
def priority_dedup(spark, d):
    c = caps(spark, d).select("event_id", "url", F.expr("ts_ms div 3600000").alias("ts_ms"), "mime", "status")
    return store.priority_dedup(c, "event_id")


@register(f"WITH {CAPS} SELECT digest, count(*) AS refs, CAST(max(k + 100) AS BIGINT) AS size FROM caps GROUP BY digest")
def digest_refcounts(spark, d):
    return store.digest_refs(caps(spark, d), F.col("k") + 100)


@register(f"""WITH {CAPS}, g AS (SELECT digest, count(*) AS n, max(k + 100) AS size FROM caps GROUP BY digest)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_digests, CAST(sum(n * size) AS BIGINT) AS bytes_all, CAST(sum(size) AS BIGINT) AS bytes_once FROM g""")
def dedup_savings(spark, d):
    return store.dedup_savings(caps(spark, d), F.col("k") + 100)


_GONE = "SELECT DISTINCT page_id FROM caps WHERE page_id % 5 = 0"


@register(f"""WITH {CAPS}, refs AS (SELECT digest, count(*) AS refs, max(k + 100) AS size FROM caps GROUP BY digest),
less AS (SELECT digest, count(*) AS n FROM caps WHERE page_id IN ({_GONE}) GROUP BY digest)
SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS freed FROM refs JOIN less USING (digest) WHERE refs - n < 1""")
def delete_cascade_freed(spark, d):
    c = caps(spark, d)
    gone = c.where("page_id % 5 = 0").select("page_id")
    return store.delete_pages(c, store.digest_refs(c, F.col("k") + 100), gone)[2]


@register(f"""WITH {CAPS}, less AS (SELECT digest, count(*) AS n FROM caps WHERE page_id IN ({_GONE}) GROUP BY digest)
SELECT digest, refs - coalesce(n, 0) AS refs, size FROM (SELECT digest, count(*) AS refs, CAST(max(k + 100) AS BIGINT) AS size FROM caps GROUP BY digest)
LEFT JOIN less USING (digest) WHERE refs - coalesce(n, 0) > 0""")
def delete_cascade_refs(spark, d):
    c = caps(spark, d)
    return store.delete_pages(c, store.digest_refs(c, F.col("k") + 100), c.where("page_id % 5 = 0").select("page_id"))[1]


@register("""SELECT doc_id, 'sha-256:' || sha256(text) AS digest, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_new
FROM documents WHERE strlen(text) > 1024
UNION ALL SELECT doc_id, NULL, true FROM documents WHERE text IS NULL OR strlen(text) <= 1024""")
def doc_content_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", store.payload_digest(F.col("text").cast("binary")).alias("digest"))
    return store.first_of_digest(docs, "doc_id").select("doc_id", "digest", "is_new")


@register(f"""WITH {CAPS}, held AS (SELECT DISTINCT url, ts_ms // 86400000 AS ts_ms FROM caps WHERE event_id % 2 = 0 AND mime <> 'warc/revisit')
SELECT c.event_id, c.url, c.mime FROM caps c WHERE c.event_id % 2 = 1
  AND NOT (c.mime = 'warc/revisit' AND EXISTS (SELECT 1 FROM held h WHERE h.url = c.url AND h.ts_ms = c.ts_ms // 86400000))""")
def revisit_insert_if_absent(spark, d):
    c = caps(spark, d).withColumn("ts_ms", F.expr("ts_ms div 86400000"))
    return store.without_seen_revisits(c.where("event_id % 2 = 1"), c.where("event_id % 2 = 0")).select("event_id", "url", "mime")


@register(f"""WITH {CAPS}, v AS (SELECT CASE WHEN k % 11 = 0 THEN NULL ELSE k % 3 <> 0 END AS matched FROM caps)
SELECT count_if(matched) AS n_valid, count_if(NOT matched) AS n_invalid, count_if(matched IS NULL) AS n_unchecked FROM v""")
def verification_summary(spark, d):
    v = caps(spark, d).select(F.col("digest").alias("id"), F.expr("case when k % 11 = 0 then null else k % 3 <> 0 end").alias("matched"))
    return stats.verification_summary(v)


@register("""WITH e AS (SELECT o_custkey AS list, o_orderkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT c_custkey AS id, c_name AS title, string_agg(CAST(page AS VARCHAR), ',' ORDER BY pos) AS pages FROM customer LEFT JOIN e ON c_custkey = list GROUP BY c_custkey, c_name""")
def curated_lists(spark, d):
    lists = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    pages = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("pages"))
    rows = store.curated_rows(pages)
    out = store.assemble_lists(lists, rows, ["page"])
    joined = F.array_join(F.transform("pages", lambda p: p["page"].cast("string")), ",")
    return out.select("id", "title", F.when(F.col("pages").isNotNull(), joined).alias("pages"))


_BLOCKS = """b AS (SELECT 'a' || (n % 3) AS archive, prefix, row_number() OVER (ORDER BY prefix) * 1000 AS block_ts, n FROM (
  SELECT DISTINCT 'com,example,u' || o_custkey || ')/' AS prefix, o_custkey % 3 AS n FROM orders))"""
_BLOCK_REQS = "q AS (SELECT event_id AS req_id, 'a' || (event_id % 3) AS archive, 'com,example,u' || user_id || ')/' || event_type AS key, CAST(event_id AS BIGINT) * 10 AS ts_ms FROM events)"


def _block_tables(spark, d):
    b = table(spark, d, "orders").select(F.expr("concat('com,example,u', o_custkey, ')/')").alias("prefix"), F.expr("concat('a', o_custkey % 3)").alias("archive")).distinct()
    q = table(spark, d, "events").select(
        F.col("event_id").alias("req_id"), F.expr("concat('a', event_id % 3)").alias("archive"), F.expr("concat('com,example,u', user_id, ')/', event_type)").alias("key"), (F.col("event_id") * 10).alias("ts_ms")
    )
    return b, q


@register(f"""WITH {_BLOCKS}, {_BLOCK_REQS}, u AS (SELECT *, lead(prefix) OVER (PARTITION BY archive ORDER BY prefix) AS upper FROM b)
SELECT req_id, q.archive, prefix FROM q JOIN u ON q.archive = u.archive AND prefix <= key || ' 9999' AND (upper IS NULL OR upper > key)""")
def block_prune(spark, d):
    b, q = _block_tables(spark, d)
    return blocks.candidate_blocks(b, q, F.col("key")).select("req_id", "archive", "prefix")


@register(f"""WITH {_BLOCKS}, {_BLOCK_REQS}, u AS (SELECT *, lead(prefix) OVER (PARTITION BY archive ORDER BY prefix) AS upper FROM b),
m AS (SELECT req_id, q.archive, prefix, row_number() OVER (PARTITION BY req_id ORDER BY abs(length(prefix) * 100 - q.ts_ms), q.archive, prefix) AS rank
      FROM q JOIN u ON q.archive = u.archive AND prefix <= 'com,example,u1' || chr(1114111) AND (upper IS NULL OR upper > 'com,example,u1') WHERE req_id % 50 = 0)
SELECT req_id, archive, prefix, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 7""")
def block_priority(spark, d):
    b, q = _block_tables(spark, d)
    q = q.where("req_id % 50 = 0").withColumn("key", F.lit("com,example,u1"))
    return blocks.nearest_candidates(b, q, F.length("prefix") * 100, F.col("key"), as_prefix=True).select("req_id", "archive", "prefix", "rank")


@register(f"""WITH {REQS}, p AS (SELECT DISTINCT regexp_replace(url, '^(https?://)www\\.', '\\1') AS u, 'w' || (event_id % 7) AS archive FROM caps WHERE mime = 'text/html'),
r AS (SELECT req_id, archive, row_number() OVER (PARTITION BY req_id ORDER BY archive) AS n FROM reqs JOIN p ON regexp_replace(url, '^(https?://)www\\.', '\\1') = u)
SELECT req_id, archive FROM r WHERE n <= 3""")
def archive_prune(spark, d):
    pages = caps(spark, d).where("mime = 'text/html'").select("url", F.expr("concat('w', event_id % 7)").alias("archive"))
    return blocks.archives_for(reqs(spark, d), pages).select("req_id", "archive")


@register(f"""WITH {CAPS} SELECT page_id % 97 AS client, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM caps GROUP BY 1""")
def client_access_stats(spark, d):
    return stats.client_stats(caps(spark, d).withColumn("client", F.expr("page_id % 97")))


@register(f"""WITH {CAPS}, s AS (SELECT page_id % 97 AS client, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM caps GROUP BY 1),
t AS (SELECT CASE WHEN client % 4 <> 0 THEN client - client % 4 ELSE client END AS root, client % 4 <> 0 AS child, n, first_ms, last_ms FROM s)
SELECT root, CAST(sum(n) AS BIGINT) AS n, min(first_ms) AS first_ms, max(last_ms) AS last_ms, CAST(count_if(child) AS BIGINT) AS children FROM t GROUP BY root""")
def client_rollup(spark, d):
    c = caps(spark, d).withColumn("client", F.expr("page_id % 97"))
    clients = c.select("client").distinct().select(
        "client", F.concat(F.lit("p"), F.col("client").cast("string")).alias("page_url"),
        F.when(F.expr("client % 4 <> 0"), F.concat(F.lit("p"), F.expr("client - client % 4").cast("string"))).alias("referrer"),
    )
    return stats.roll_up(stats.with_parents(stats.client_stats(c), clients))


@register(f"""WITH {CAPS} SELECT event_id, page_id % 97 AS client, url, CAST(row_number() OVER (PARTITION BY page_id % 97, url ORDER BY event_id) - 1 AS INTEGER) AS skip
FROM caps WHERE k % 2 = 0 OR url LIKE '%/view'""")
def repeat_counter(spark, d):
    c = caps(spark, d).withColumn("client", F.expr("page_id % 97"))
    return stats.repeat_counter(c, "client", "url", "event_id", F.expr("k % 2 = 0") | F.col("url").endswith("/view")).select("event_id", "client", "url", "skip")


@register(f"WITH {CAPS} SELECT event_id, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d%H%M%S') AS ts14 FROM caps")
def ts14_format(spark, d):
    return caps(spark, d).select("event_id", D.ms_to_ts14(F.col("ts_ms")).alias("ts14"))


@register("""WITH e AS (SELECT event_id, left(strftime(ts, '%Y%m%d%H%M%S') || '000', CAST(4 + event_id % 14 AS INTEGER)) AS t FROM events),
f AS (SELECT event_id, t, t || right('00000101000000000', 17 - length(t)) AS full17 FROM e)
SELECT event_id, t, epoch_us(try_strptime(left(full17, 14), '%Y%m%d%H%M%S')) // 1000 + CAST(right(full17, 3) AS BIGINT) AS ts_ms FROM f""")
def ts14_parse(spark, d):
    """Stamps cut anywhere; those that name no day have no time."""
    t = F.expr("left(concat(date_format(ts, 'yyyyMMddHHmmss'), '000'), cast(4 + event_id % 14 as int))")
    return table(spark, d, "events").select("event_id", t.alias("t")).withColumn("ts_ms", D.ts_to_ms(F.col("t")))


@register(f"""WITH {CAPS}, p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':p' || page_id || '/' ELSE '' END ||
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(20200101000000 + event_id AS VARCHAR) END || CASE WHEN event_id % 2 = 0 THEN 'mp_' ELSE '' END || '/' || url ||
  CASE WHEN event_id % 5 = 0 THEN '#top' ELSE '' END AS path FROM caps)
SELECT event_id, nullif(regexp_extract(path, '^:([^/]+)/', 1), '') AS page_id, nullif(regexp_extract(path, '^(?:\\:[^/]+/)?([0-9]*)', 1), '') AS ts,
  nullif(regexp_extract(path, '^(?:\\:[^/]+/)?[0-9]*([a-z]+_)?/', 1), '') AS modifier, regexp_extract(path, '(https://[^#]*)', 1) AS url,
  CASE WHEN contains(path, '#') THEN '#top' END AS fragment FROM p""")
def parse_replay_url(spark, d):
    path = F.expr("""concat(case event_id % 3 when 1 then concat(':p', page_id, '/') else '' end,
      case when event_id % 4 = 0 then '' else cast(20200101000000 + event_id as string) end, case when event_id % 2 = 0 then 'mp_' else '' end, '/', url,
      case when event_id % 5 = 0 then '#top' else '' end)""")
    return caps(spark, d).select("event_id", *[c.alias(k) for k, c in U.parse_replay(path).items()])


_SURT = r"""array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1), '^www[0-9]*\.', ''), '.')), ',') || ')' ||
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) = '' OR starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '?')
       THEN '/' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) END"""


@register(f"SELECT page_id, lower({_SURT}) AS surt FROM pages")
def surt_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.surt(F.col("url")).alias("surt"))


@register(r"""WITH u AS (SELECT page_id, url, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=a' || page_id || '&v=1' AS asked FROM pages)
SELECT page_id, asked, regexp_replace(asked, '([?&])utm_[a-z]+=[^&]*(&|$)', '\1\2') AS canon, left(asked, strpos(asked, '?')) AS prefix FROM u""")
def cache_buster_strip(spark, d):
    """The rule for arguments that only defeat caches, as the lookup routes requests by it."""
    from palimpsest.operators.fuzzy import routed

    asked = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=a"), "page_id", F.lit("&v=1"))
    pages = table(spark, d, "pages").select("page_id", asked.alias("asked"))
    return pages.withColumn("_r", routed(F.col("asked"))).select("page_id", "asked", F.col("_r.canon").alias("canon"), F.when(F.col("asked").isNotNull(), F.col("_r.prefix")).alias("prefix")).withColumn("canon", F.when(F.col("asked").isNotNull(), F.col("canon")))


_KINDS = """SELECT event_id, 'https://' || CASE event_id % 6 WHEN 0 THEN 'www.youtube.com/embed/v' || user_id || '?rel=0'
  WHEN 1 THEN 'lh3.googleusercontent.com/p' || user_id || '=s' || event_id WHEN 2 THEN 'x.example.com/lib' || user_id || '.js?v=' || event_id
  WHEN 3 THEN 'static.example.com/resizer/' || event_id || '/10x10/i' || user_id || '.png' WHEN 4 THEN 'mobile.twitter.com/u' || user_id || '/status/' || event_id || '?s=20'
  ELSE 'plain.example.com/p' || user_id END AS url FROM events"""


@register(f"""WITH u AS ({_KINDS})
SELECT event_id, url, CASE event_id % 6 WHEN 0 THEN left(url, strpos(url, '?') - 1) WHEN 1 THEN left(url, strpos(url, '=s') - 1) WHEN 2 THEN left(url, strpos(url, '?') - 1)
  WHEN 3 THEN regexp_replace(url, '/resizer/[^/]+/[0-9x]+/', '/resizer/') WHEN 4 THEN left(url, strpos(url, '?') - 1) ELSE url END AS canon,
  CASE event_id % 6 WHEN 1 THEN left(url, strpos(url, '=s') + 1) WHEN 3 THEN left(url, strpos(url, '/resizer/') + 8) WHEN 5 THEN url ELSE left(url, strpos(url, '?')) END AS prefix FROM u""")
def fuzzy_canonical(spark, d):
    """URLs of five kinds of rules, and of none, through the rule table."""
    from palimpsest.operators.fuzzy import routed

    url = F.expr("""concat('https://', case event_id % 6 when 0 then concat('www.youtube.com/embed/v', user_id, '?rel=0') when 1 then concat('lh3.googleusercontent.com/p', user_id, '=s', event_id)
      when 2 then concat('x.example.com/lib', user_id, '.js?v=', event_id) when 3 then concat('static.example.com/resizer/', event_id, '/10x10/i', user_id, '.png')
      when 4 then concat('mobile.twitter.com/u', user_id, '/status/', event_id, '?s=20') else concat('plain.example.com/p', user_id) end)""")
    rows = table(spark, d, "events").select("event_id", url.alias("url"))
    return rows.withColumn("_r", routed(F.col("url"))).select("event_id", "url", "_r.canon", "_r.prefix")


@register(f"""WITH {CAPS} SELECT event_id, url, CAST(NULL AS VARCHAR) AS orig_url FROM caps
UNION ALL SELECT event_id, regexp_replace(url, '/(view|click)$', '/page'), url FROM caps WHERE status BETWEEN 200 AND 399 AND status NOT IN (204, 304) AND regexp_matches(url, '/(view|click)$')""")
def fuzzy_twin_rows(spark, d):
    return store.fuzzy_twins(caps(spark, d), F.regexp_replace("url", r"/(view|click)\z", "/page")).select("event_id", "url", "orig_url")


@register("""SELECT p_partkey, n_nationkey, CAST(greatest(0, least(length(p_name), length(n_name)) - levenshtein(p_name, n_name)) AS BIGINT) AS score
FROM part JOIN nation ON p_partkey % 25 = n_nationkey""")
def lev_score(spark, d):
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    return p.join(n, F.expr("p_partkey % 25 = n_nationkey")).select("p_partkey", "n_nationkey", U.lev_score(F.col("p_name"), F.col("n_name")).cast("long").alias("score"))


_HREFS = "(SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@register(f"""SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN '/coll/20200101000000mp_/' || regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href
  WHEN starts_with(href, 'http://') OR starts_with(href, 'https://') THEN '{PREFIX}' || href ELSE href END AS rewritten FROM {_HREFS}""")
def rewrite_links(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.select("page_id", "href", U.rewrite_links(F.col("href"), PREFIX, U.origin_of(F.col("url"))).alias("rewritten"))


@register(r"""SELECT page_id, nullif(lower(regexp_extract(html[:1024], '(?i)<meta[^>]+charset\s*=\s*["'']?\s*([a-z0-9_:.-]+)', 1)), '') AS charset FROM pages""")
def charset_detect(spark, d):
    return table(spark, d, "pages").select("page_id", X.charset(F.col("html")).alias("charset"))


@register("""SELECT event_id, 'fresh' || user_id || '({"k":' || event_id || '});' AS body FROM events""")
def jsonp_rewrite(spark, d):
    e = table(spark, d, "events")
    body = F.expr("""concat('/* old */ stale(', '{"k":', event_id, '});')""")
    url = F.expr("concat('https://x.example/api?a=1&callback=fresh', user_id)")
    return e.select("event_id", R.rewrite_jsonp(body, url).alias("body"))


@register(f"""WITH {CAPS} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'css' WHEN event_id % 9 = 1 THEN CASE WHEN mime = 'application/json' THEN 'json' ELSE 'js' END
  WHEN mime = 'text/html' THEN 'html' WHEN mime = 'text/css' THEN 'css' WHEN mime = 'application/json' THEN 'json' ELSE '' END AS mode FROM caps""")
def rewrite_mode(spark, d):
    dest = F.expr("case event_id % 9 when 0 then 'style' when 1 then 'script' else '' end")
    return caps(spark, d).select("event_id", R.rewrite_mode(dest, F.col("mime"), F.col("url"), F.lit(""), F.lit(None).cast("string")).alias("mode"))


@register("""SELECT name, CASE WHEN name IN ('etag', 'server', 'vary', 'content-encoding', 'access-control-allow-origin') THEN 'rename' WHEN name = 'location' THEN 'url'
  WHEN name = 'link' THEN 'link' WHEN name = 'content-length' THEN 'length' ELSE 'keep' END AS policy, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT ['etag', 'server', 'vary', 'content-encoding', 'access-control-allow-origin', 'location', 'link', 'content-length', 'content-type', 'date', 'x-own', 'set-cookie'][1 + event_id % 12] AS name FROM events) GROUP BY 1, 2""")
def rewrite_headers(spark, d):
    names = ["etag", "server", "vary", "content-encoding", "access-control-allow-origin", "location", "link", "content-length", "content-type", "date", "x-own", "set-cookie"]
    rows = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, names)), F.expr("cast(1 + event_id % 12 as int)")).alias("name"))
    return rows.groupBy("name", H.policy(F.col("name")).alias("policy")).agg(F.count("*").alias("n"))


@register(f"SELECT page_id, '<' || CASE WHEN regexp_matches(url, '^https?://') THEN '{PREFIX}' ELSE '' END || url || '>; rel=preload; as=script' AS link FROM pages")
def link_header(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", H.link_column(F.concat(F.lit("<"), F.col("url"), F.lit(">; rel=preload; as=script")), PREFIX).alias("link"))


@register("""WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM pages WHERE url IS NOT NULL),
r AS (SELECT * FROM (VALUES ('example.com', '.ad', false), ('example.net', '#banner', false), ('example.com', '.promo', false), ('blog.tionble.example.com', '.ad', true)) t(domain, selector, exception)),
s AS (SELECT host, selector, exception FROM h JOIN r ON host = domain OR host LIKE '%.' || domain),
n AS (SELECT DISTINCT host, selector FROM s WHERE NOT exception AND NOT EXISTS (SELECT 1 FROM s x WHERE x.exception AND x.host = s.host AND x.selector = s.selector)),
g AS (SELECT host, string_agg(selector, ', ' ORDER BY selector) AS css FROM n GROUP BY host)
SELECT h.host, coalesce(css, '.generic') || ' { display: none !important; }' AS css FROM h LEFT JOIN g USING (host)""")
def adblock_rules(spark, d):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["! comment", "example.com##.ad", "example.net###banner", "example.com##.promo", "blog.tionble.example.com#@#.ad", "##.generic", "no rule"])], "line_no int, line string")
    hosts = table(spark, d, "pages").where("url is not null").select(F.regexp_extract("url", "://([^/?#:]*)", 1).alias("host"))
    return adblock.css_for(hosts, adblock.parse_rules(lines))


@register("""WITH c AS (SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role, true) AS fresh FROM conversations),
r AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, turn, CAST(run AS BIGINT) AS run, CAST((row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1) // 2 AS BIGINT) AS pair FROM r""")
def record_pairing(spark, d):
    rows = table(spark, d, "conversations")
    out = store.pair_adjacent(rows, "conv_id", "turn", F.col("role") == "user", F.col("role") != "user")
    return out.select("conv_id", "turn", F.col("_run").alias("run"), "pair")


@register(f"""WITH {CAPS} SELECT event_id, status, CASE status WHEN 200 THEN 'OK' WHEN 302 THEN 'Found' WHEN 304 THEN 'Not Modified' WHEN 404 THEN 'Not Found' WHEN 503 THEN 'Service Unavailable' END AS status_text FROM caps""")
def status_texts(spark, d):
    return caps(spark, d).select("event_id", "status", U.status_text(F.col("status")).alias("status_text"))


@register(f"""WITH {CAPS} SELECT event_id, status = 200 AND mime = 'text/html' AS is_page FROM caps""")
def page_heuristic(spark, d):
    return caps(spark, d).select("event_id", P.is_page(F.col("url"), F.col("status"), F.col("mime")).alias("is_page"))


@register("""WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM pages WHERE url IS NOT NULL),
p AS (SELECT host, string_split(regexp_replace(host, '^www\\.', ''), '.') AS l FROM h)
SELECT host, array_to_string(l[i:], '.') AS suffix FROM p, unnest(range(1, greatest(len(l), 2))) t(i)""")
def domain_suffixes(spark, d):
    hosts = table(spark, d, "pages").where("url is not null").select(F.regexp_extract("url", "://([^/?#:]*)", 1).alias("host")).distinct()
    return hosts.select("host", F.explode(U.domain_suffixes(F.col("host"))).alias("suffix"))


@register(r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[ >].*?</script\s*>', chr(1), 'g'), '(?is)<style[ >].*?</style\s*>', chr(1), 'g'), '(?is)<header[ >].*?</header\s*>', chr(1), 'g'), '(?is)<footer[ >].*?</footer\s*>', chr(1), 'g'), '(?is)<noscript[ >].*?</noscript\s*>', chr(1), 'g'), '(?s)<!.*?>', chr(1), 'g'), '</?[A-Za-z][^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ') AS text FROM pages""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_text("html").alias("text"))


@register()
def rewrite_html(spark, d):
    from palimpsest.functions.rewrite.html import page_rewriter

    return table(spark, d, "pages").select("page_id", page_rewriter(PREFIX)("html", "url").alias("html"))


@register()
def fuzzy_best_match(spark, d):
    """Pages asked for under another query string, against all pages by prefix."""
    from palimpsest.operators.fuzzy import best_matches

    pages = table(spark, d, "pages").where("url is not null")
    asked = pages.select(F.col("page_id").alias("req_id"), F.concat(F.substring_index("url", "#", 1), F.when(F.col("url").contains("?"), "&v=1").otherwise("?v=1")).alias("url"))
    held = pages.select("url", F.lit(200).alias("status"), F.col("page_id").alias("ts_ms"))
    return best_matches(asked, held).select("req_id", "url", "hit_url", "score")


@register(_plain_sql(SKIP).replace("SELECT req_id, CASE", "\n, h AS (SELECT req_id, CASE").rstrip() + """),
p AS (SELECT digest, min(digest || ':' || mime) AS body FROM caps GROUP BY 1)
SELECT req_id, event_id, CASE status WHEN 200 THEN 'OK' WHEN 302 THEN 'Found' WHEN 304 THEN 'Not Modified' WHEN 404 THEN 'Not Found' WHEN 503 THEN 'Service Unavailable' END AS status_text,
  'bytes 0-9/' || strlen(body) AS content_range, CAST(10 AS INTEGER) AS n_body FROM h JOIN caps USING (event_id) JOIN p USING (digest)""")
def payload_replay(spark, d):
    """The whole resolve: as-of capture, payload by digest, status text, byte range."""
    c = caps(spark, d)
    found = lookup.lookup(reqs(spark, d), c, CAPTURE_COLUMNS).where("hit is not null").select("req_id", "url", "hit.*")
    bodies = c.select("digest", F.concat_ws(":", "digest", "mime").cast("binary").alias("payload")).groupBy("digest").agg(F.min("payload").alias("payload"))
    full = lookup.with_payload(found, bodies)
    part = X.byte_range(F.col("payload"), F.lit("bytes=0-9"))
    return full.select("req_id", "event_id", U.status_text(F.col("status")).alias("status_text"), part["content_range"].alias("content_range"), F.octet_length(part["body"]).alias("n_body"))


_VARIANTS = """v AS (SELECT e.event_id, n, (320 << n) + k AS w, (200 << n) AS h, 100000 * (n + 1) + k AS rate
  FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) e, unnest([0, 1, 2]) t(n))"""


def _variants(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("event_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("n"), "k").selectExpr("event_id", "n", "shiftleft(320, n) + k as w", "shiftleft(200, n) as h", "100000 * (n + 1) + k as rate")


@register(f"WITH {_VARIANTS} SELECT event_id, 'v' || arg_max(n, w * h) || '.m3u8' AS uri FROM v WHERE w * h <= 412800 GROUP BY event_id")
def hls_select(spark, d):
    from palimpsest.functions.rewrite.video import hls_variants, rewrite_hls

    @F.pandas_udf(T.StringType())
    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hls_variants(rewrite_hls(t))[0]["uri"])

    line = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d,RESOLUTION=%dx%d\nv%d.m3u8", "rate", "w", "h", "n")
    lists = _variants(spark, d).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    return lists.select("event_id", kept(F.concat(F.lit("#EXTM3U\n"), F.col("t"))).alias("uri"))


@register(f"WITH {_VARIANTS} SELECT event_id, 'r' || arg_max(n, w * h) AS rep_id FROM v WHERE w * h <= 412800 GROUP BY event_id")
def dash_select(spark, d):
    from palimpsest.functions.rewrite.video import dash_representations, rewrite_dash

    @F.pandas_udf(T.StringType())
    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dash_representations(rewrite_dash(t))[0]["rep_id"])

    rep = F.format_string('<Representation id="r%d" bandwidth="%d" width="%d" height="%d"/>', "n", F.col("rate") + 2_000_000, "w", "h")
    sets = _variants(spark, d).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(rep)), "").alias("t"))
    return sets.select("event_id", kept(F.concat(F.lit("<MPD><Period><AdaptationSet>"), F.col("t"), F.lit("</AdaptationSet></Period></MPD>"))).alias("rep_id"))


@register(f"WITH {_VARIANTS} SELECT event_id, 'u' || arg_max(n, rate) AS url FROM v WHERE rate <= 250000 AND n <> 1 GROUP BY event_id")
def variant_select(spark, d):
    row = F.struct(F.col("rate").cast("long").alias("bitrate"), F.when(F.col("n") == 1, "application/x-other").otherwise("video/mp4").alias("content_type"), F.concat(F.lit("u"), "n").alias("url"))
    rows = _variants(spark, d).groupBy("event_id").agg(F.collect_list(row).alias("variants"))
    return rows.select("event_id", R.best_variant(F.col("variants"), 250_000).alias("url"))


@register("""WITH t AS (SELECT doc_id, doc_id % 3 AS kind, strlen(text) AS n FROM documents)
SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 OR kind < 2 AND n <= 100 * kind THEN 416 ELSE 206 END AS status,
  CASE WHEN n > 0 THEN CASE kind WHEN 2 THEN least(40, n) ELSE CASE WHEN n > 100 * kind THEN least(50, n - 100 * kind) END END END AS n_body FROM t""")
def byte_ranges(spark, d):
    """Ranges from the start, from byte 100, and of the last 40 bytes; no byte of an empty body can be had."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    header = F.expr("case doc_id % 3 when 0 then 'bytes=0-49' when 1 then 'bytes=100-149' else 'bytes=-40' end")
    part = X.byte_range(F.col("body"), header)
    return docs.select("doc_id", part["status"].alias("status"), F.octet_length(part["body"]).cast("long").alias("n_body"))


@register("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'id=' || user_id || '; Path=/' || CASE WHEN event_id % 3 = 0 THEN '; Secure' ELSE '' END ELSE 'id=' || user_id || '; Path=/' END AS cookie FROM events""")
def cookie_rewrite(spark, d):
    header = F.expr("concat('id=', user_id, '; Expires=Wed, 01 Jan 2031 00:00:00 GMT; Path=/; HttpOnly', case when event_id % 3 = 0 then '; Secure' else '' end)")
    return table(spark, d, "events").select("event_id", U.cookies(header, F.expr("event_id % 2 = 0")).alias("cookie"))


@register(f"""WITH s AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<style>([^<]*)</style>', 1)) AS style, generate_subscripts(regexp_extract_all(html, '<style>([^<]*)</style>', 1), 1) - 1 AS nth FROM pages)
SELECT page_id, CAST(nth AS INTEGER) AS nth, style || ' b{{background:url(' || CASE WHEN url IS NULL THEN '/coll/20200101000000mp_//bg.png' ELSE '/coll/20200101000000mp_/' || regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/bg.png' END || ')}}' AS css FROM s""")
def rewrite_css(spark, d):
    """Style sheets of the pages, with a link each."""
    @F.pandas_udf(T.StringType())
    def css(texts: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([R.rewrite_css(t, PREFIX, b) for t, b in zip(texts, base, strict=True)])

    styles = F.posexplode(F.regexp_extract_all("html", F.lit("<style>([^<]*)</style>"), 1)).alias("nth", "style")
    rows = table(spark, d, "pages").select("page_id", "url", styles)
    return rows.select("page_id", "nth", css(F.concat("style", F.lit(" b{background:url(/bg.png)}")), F.coalesce("url", F.lit(""))).alias("css"))


@register("""WITH s AS (SELECT page_id, unnest(l) AS script, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS nth FROM (SELECT page_id, regexp_extract_all(html, '<script>(.*?)</script>', 1, 's') AS l FROM pages))
SELECT page_id, nth, 'var __replay_get = function(n) { return (self.__replay && self.__replay.get && self.__replay.get(n)) || self[n]; };' || chr(10) || '{' || chr(10) || 'let window = __replay_get("window"); let self = __replay_get("self"); let document = __replay_get("document"); let location = __replay_get("location"); let top = __replay_get("top"); let parent = __replay_get("parent"); let frames = __replay_get("frames"); let opener = __replay_get("opener"); let globalThis = __replay_get("globalThis");' || chr(10) || 'let arguments;' || chr(10) || chr(10) ||
  script || ';window.seen = document.title' || chr(10) || chr(10) || '}' AS js FROM s""")
def rewrite_js(spark, d):
    """Scripts of the pages, with a use of a global each."""
    from palimpsest.functions.rewrite.js import rewrite_js as js

    @F.pandas_udf(T.StringType())
    def scripts(texts: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([js(t, PREFIX, b) for t, b in zip(texts, base, strict=True)])

    found = F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), 1)).alias("nth", "script")
    rows = table(spark, d, "pages").select("page_id", "url", found)
    return rows.select("page_id", "nth", scripts(F.concat("script", F.lit(";window.seen = document.title")), F.coalesce("url", F.lit(""))).alias("js"))
