"""More registered queries: one for each smaller operator and function, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import fuzzy_match, predicates as P
from palimpsest.functions import text as X
from palimpsest.functions import timestamps as D
from palimpsest.functions import urls as U
from palimpsest.functions.rewrite import headers as H
from palimpsest.functions.rewrite import text as R
from palimpsest.operators import adblock, blocks, collections, integrity, listing, lookup, stats, store
from palimpsest.plans.views import CAPS, CAPTURE_COLUMNS, REQS, SKIP, caps, reqs
from palimpsest.session import table
from palimpsest.sources import files, har, indexes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PREFIX = "https://replay.example/coll/20200101000000mp_/"
PATH = "/coll/20200101000000mp_/"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a file of few row groups is read by few, too few for slow functions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _udf(kind: str, f: Callable):  # noqa: ANN202
    """An Arrow UDF of a scalar function over several columns."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object)

    one, two, three = (lambda a: run(a)), (lambda a, b: run(a, b)), (lambda a, b, c: run(a, b, c))
    n = f.__code__.co_argcount - len(f.__defaults__ or ())
    kinds = {1: (one, [pd.Series]), 2: (two, [pd.Series] * 2), 3: (three, [pd.Series] * 3)}
    g, types = kinds[n]
    g.__annotations__ = {**dict(zip("abc", types, strict=False)), "return": pd.Series}
    return F.pandas_udf(g, kind)


# --- sources -------------------------------------------------------------------------------------

_CDX_ROWS = """r AS (SELECT event_id, url, ts_ms, status, mime, digest, event_id % 7 AS kind FROM caps)"""


@register(f"""WITH {CAPS}, {_CDX_ROWS}
SELECT CASE WHEN kind = 4 THEN url || '?__wb_method=POST&a=' || event_id ELSE url END AS url, ts_ms // 1000 * 1000 AS ts_ms,
  CASE WHEN kind = 1 THEN 200 ELSE status END AS status, mime, 'sha1:' || digest AS digest, CASE WHEN kind = 4 THEN 'POST' ELSE 'GET' END AS method,
  event_id * 10 AS start, 100 + event_id % 9 AS length FROM r WHERE kind NOT IN (3, 5)""")
def cdxj_scan(spark, d):
    """Lines with a key and bare ones, without a status, of HEAD and POST requests, and broken ones."""
    kind = F.expr("event_id % 7")
    j = F.to_json(F.struct(
        F.concat("url", F.when(kind == 2, "#frag").otherwise("")).alias("url"), F.when(kind != 1, F.col("status").cast("string")).alias("status"), "mime", "digest",
        F.expr("cast(event_id * 10 as string)").alias("offset"), F.expr("cast(100 + event_id % 9 as string)").alias("length"), F.lit("a.warc").alias("filename"),
        F.when(kind == 3, "HEAD").when(kind == 4, "POST").alias("method"), F.when(kind == 4, F.concat(F.lit("a="), F.col("event_id"))).alias("requestBody"),
        F.when(kind == 2, D.ms_to_ts14(F.col("ts_ms"))).alias("timestamp"),
    ))
    head = F.concat(U.surt(F.col("url")), F.lit(" "), D.ms_to_ts14(F.col("ts_ms")), F.lit(" "))
    line = F.when(kind == 5, F.concat(head, F.lit('{"url": '))).otherwise(F.concat(F.when(kind == 2, "").otherwise(head), j))
    found = indexes.parse_cdxj(caps(spark, d).select(F.trim(line).alias("line")))
    return found.select("url", "ts_ms", "status", "mime", "digest", "method", "source.start", F.col("source.length").cast("long").alias("length"))


@register("""SELECT 'https://e.example/' || page_id AS url, coalesce(url, 'https://e.example/' || page_id) AS title, 1704067200000 + page_id * 1000 AS ts_ms, html AS text FROM pages""")
def page_list_scan(spark, d):
    """JSON lines with a heading; times as numbers and as stamps."""
    url = F.concat(F.lit("https://e.example/"), "page_id")
    ms = F.lit(1704067200000) + F.col("page_id") * 1000
    line = F.to_json(F.struct(url.alias("url"), F.col("url").alias("title"), F.col("html").alias("text"), F.when(F.expr("page_id % 2 = 0"), ms.cast("string")).alias("ts"), F.when(F.expr("page_id % 2 = 1"), D.ms_to_ts14(ms)).alias("timestamp")))
    pages = table(spark, d, "pages").select(line.alias("line"))
    lines = pages.unionByName(spark.createDataFrame([('{"format": "json-pages-1.0", "id": "pages"}',)], "line string"))
    return indexes.parse_pages(lines).select("url", "title", "ts_ms", "text")


@register("""SELECT 'w1' AS archive, 'com,example)/' || o_orderkey || ' 2020' AS prefix, 'cdx-' || o_custkey || '.gz' AS filename, o_orderkey * 100 AS "offset", o_custkey + 7 AS length FROM orders""")
def sparse_index_scan(spark, d):
    key = F.concat(F.lit("com,example)/"), "o_orderkey", F.lit(" 2020"))
    name = F.concat(F.lit("cdx-"), "o_custkey", F.lit(".gz"))
    tab = F.concat_ws("\t", key, name, F.expr("cast(o_orderkey * 100 as string)"), F.expr("cast(o_custkey + 7 as string)"), F.lit("1"))
    j = F.concat(key, F.lit(" "), F.to_json(F.struct(name.alias("filename"), F.expr("o_orderkey * 100").alias("offset"), F.expr("o_custkey + 7").alias("length"))))
    lines = table(spark, d, "orders").select(F.when(F.expr("o_orderkey % 2 = 0"), tab).otherwise(j).alias("line"))
    lines = lines.unionByName(spark.createDataFrame([('!meta 0 {"format": "cdxj-gzip-1.0"}',), ("",)], "line string"))
    return indexes.parse_idx(lines, "w1").select("archive", "prefix", "filename", "offset", "length")


def _har(spark, d):
    c = caps(spark, d).withColumn("page", F.concat(F.lit("p"), F.expr("event_id div 5")))
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pair = lambda n, v: F.array(F.struct(F.lit(n).alias("name"), v.alias("value")))
    body = F.concat(F.lit("body "), "event_id")
    content = F.struct(F.when(F.expr("k % 4 = 3"), F.lit(None)).when(F.expr("k % 2 = 0"), F.base64(F.encode(body, "UTF-8"))).otherwise(body).alias("text"), F.when(F.expr("k % 2 = 0"), "base64").alias("encoding"), F.concat("mime", F.lit("; charset=utf-8")).alias("mimeType"))
    entry = F.struct(F.col("page").alias("pageref"), iso.alias("startedDateTime"), F.struct(F.concat("url", F.lit("#x")).alias("url"), F.lit("GET").alias("method"), pair("Accept", F.lit("*/*")).alias("headers")).alias("request"),
                     F.struct(F.col("status").cast("int").alias("status"), pair("X-Own", F.col("mime")).alias("headers"), content.alias("content")).alias("response"))
    page = F.struct(F.col("page").alias("id"), F.when(F.expr("event_id div 5 % 3 = 0"), F.concat(F.lit("http://t.example/"), "page")).otherwise("A title").alias("title"), iso.alias("startedDateTime"), F.struct(F.expr("double(event_id div 5 % 2)").alias("onLoad")).alias("pageTimings"))
    by = c.select(F.expr("event_id div 20").alias("file"), "event_id", entry.alias("e"), F.when(F.expr("event_id % 5 = 0"), page).alias("p"))
    docs = by.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "e"))), lambda x: x["e"]).alias("entries"), F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p"))), lambda x: x["p"])).alias("pages"))
    return har.parse_har(docs.select("file", F.to_json(F.struct(F.struct("pages", "entries").alias("log"))).alias("text")))


@register(f"""WITH {CAPS} SELECT url, ts_ms, status, mime, 'p' || (event_id // 5) AS page_id, 'body ' || event_id AS body, mime AS own FROM caps WHERE k % 4 <> 3""")
def har_captures(spark, d):
    return har.har_captures(_har(spark, d)).select("url", "ts_ms", "status", "mime", "page_id", F.decode("payload", "UTF-8").alias("body"), F.col("resp_headers")["x-own"].alias("own"))


@register(f"""WITH {CAPS} SELECT 'p' || (event_id // 5) AS id, CASE WHEN event_id // 5 % 3 = 0 THEN 'http://t.example/p' || (event_id // 5) ELSE url || '#x' END AS url,
  CASE WHEN event_id // 5 % 3 = 0 THEN 'http://t.example/p' || (event_id // 5) ELSE 'A title' END AS title, ts_ms FROM caps WHERE event_id % 5 = 0 AND event_id // 5 % 2 = 1""")
def har_pages(spark, d):
    return har.har_pages(_har(spark, d)).select("id", "url", "title", "ts_ms")


@register("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'warc' WHEN 2 THEN 'gzip' ELSE 'text' END AS kind FROM documents""")
def file_kinds(spark, d):
    start = F.expr("case doc_id % 4 when 0 then x'504B0304' when 1 then x'574152432F312E31' when 2 then x'1F8B0800' else x'7B22' end")
    return table(spark, d, "documents").select("doc_id", files.file_kind(F.concat(start, F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).alias("kind"))


@register("""SELECT page_id AS id, title, archive FROM (SELECT page_id, url AS title, page_id % 3 AS f FROM pages) LEFT JOIN (VALUES (0, 'h0'), (1, 'h1')) t(f, archive) USING (f)
UNION ALL SELECT -1, 'two', 'h1'""")
def pages_of_archives(spark, d):
    """Pages with their archive's hash; archives from a manifest of several."""
    text = '{"resources": [{"name": "f0", "hash": "sha256:h0", "path": "f0.wacz"}, {"name": "f1", "hash": "h1", "path": "f1.wacz"}], "initialPages": [{"id": "-1", "url": "u", "title": "two", "filename": "f1"}]}'
    archives, first = indexes.multi_manifest(spark, text)
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.expr("concat('f', page_id % 3)").alias("filename"))
    return indexes.pages_with_archives(pages.unionByName(first.select("id", "title", "filename")), archives).select(F.col("id").cast("long").alias("id"), "title", "archive")


# --- store and catalog ---------------------------------------------------------------------------

@register(f"""WITH {CAPS}, a AS (SELECT event_id, url, ts_ms // 3600000 AS t, mime, status, CAST(event_id % 2 AS INTEGER) AS gen FROM caps), r AS (
  SELECT *, row_number() OVER (PARTITION BY url, t ORDER BY CASE WHEN mime = 'warc/revisit' THEN 2 WHEN status >= 300 THEN 1 ELSE 0 END, gen DESC, event_id DESC) AS n FROM a)
SELECT url, t AS ts_ms, event_id FROM r WHERE n = 1""")
def bulk_upsert(spark, d):
    c = caps(spark, d).select("event_id", "url", F.expr("ts_ms div 3600000").alias("ts_ms"), "mime", "status")
    no_time = c.withColumn("ts_ms", F.lit(None).cast("long"))  # dropped
    return store.upsert(c.where("event_id % 2 = 0"), c.where("event_id % 2 = 1").unionByName(no_time), "event_id").select("url", "ts_ms", "event_id")


@register("""SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END, url) AS title, CASE page_id % 3 WHEN 0 THEN 1704067200000 + page_id WHEN 1 THEN 1704067200000 ELSE 1704067201500 END AS ts_ms,
  CASE WHEN page_id % 5 = 0 THEN 17 ELSE CAST(page_id % 5 AS INTEGER) END AS state FROM pages""")
def page_defaults(spark, d):
    rows = table(spark, d, "pages").selectExpr(
        "page_id", "url", "case when page_id % 2 = 0 then concat('T', page_id) end as title", "case when page_id % 3 = 0 then 1704067200000 + page_id end as ts_ms",
        "case when page_id % 3 = 1 then '20240101000000' end as timestamp", "case when page_id % 3 = 2 then '2024-01-01T00:00:01.500Z' end as date", "cast(null as string) as datetime", "cast(page_id % 5 as int) as state",
    )
    return store.normalize_pages(rows).select("page_id", "title", "ts_ms", "state")


@register("""SELECT p_partkey AS id, p_brand AS expected, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_partkey % 3 = 0 END AS matched FROM part""")
def verification_rows(spark, d):
    p = table(spark, d, "part")
    expected = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("expected"))
    actual = p.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("id"), F.when(F.expr("p_partkey % 3 = 0"), F.col("p_brand")).otherwise("other").alias("actual"))
    return stats.verify(expected, actual)


@register("""SELECT max(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS "ASIA", max(CASE WHEN r_name = 'EUROPE' THEN r_regionkey END) AS "EUROPE", CAST(NULL AS INTEGER) AS missing FROM region""")
def verification_properties(spark, d):
    rows = table(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("expected"))
    return stats.property_pivot(rows, ["ASIA", "EUROPE", "missing"])


_COLLECTIONS = """c AS (SELECT c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'archive' WHEN 2 THEN 'archivezip' ELSE 'remoteproxy' END AS type, c_custkey FROM customer)"""


def _collections(spark, d):
    kind = F.expr("case c_custkey % 4 when 0 then 'live' when 1 then 'archive' when 2 then 'archivezip' else 'remoteproxy' end")
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), kind.alias("type"), F.col("c_custkey").alias("size"), F.col("c_custkey").alias("total_size"), "c_custkey")


@register(f"WITH {_COLLECTIONS} SELECT name, type FROM c WHERE type IN ('archive', 'archivezip')")
def collection_list(spark, d):
    return collections.listed(_collections(spark, d)).select("name", "type")


@register(f"""WITH {_COLLECTIONS} SELECT name, type FROM c WHERE name NOT IN ('Customer#000000003', 'Customer#000000007') UNION ALL SELECT 'new one', 'archive'""")
def collection_changes(spark, d):
    """New collections added, those already there kept, two deleted."""
    c = _collections(spark, d).select("name", "type")
    new = spark.createDataFrame([("new one", "archive"), ("Customer#000000001", "changed")], "name string, type string")
    return collections.delete(collections.create(c, new), ["Customer#000000003", "Customer#000000007"])


@register("""WITH g AS (SELECT o_custkey AS k, sum(o_orderkey) AS f, count(*) AS n FROM orders GROUP BY 1)
SELECT c_name AS name, CAST(c_custkey + coalesce(f, 0) AS BIGINT) AS total_size, CAST(c_custkey + coalesce(n, 0) AS BIGINT) AS size FROM customer LEFT JOIN g ON k = c_custkey""")
def collection_sizes(spark, d):
    growth = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("c_name").alias("name"), F.col("o_orderkey").alias("full"), F.lit(1).alias("dedup"))
    return collections.add_sizes(_collections(spark, d), growth).select("name", "total_size", "size")


@register("""SELECT c_nationkey AS crawl_id, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS archives FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def seed_archives(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("crawl_id"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") > 0).alias("has_seed"))
    return collections.archive_groups(c).select("crawl_id", F.array_join("archives", ",").alias("archives"))


@register(f"""WITH {CAPS} SELECT digest, count(*) AS n FROM (SELECT DISTINCT digest, k FROM caps) GROUP BY digest""")
def payload_commit(spark, d):
    """Bodies loaded on demand join those that are stored; none is stored twice."""
    c = caps(spark, d).select("digest", F.concat(F.lit("b"), "digest").cast("binary").alias("payload"))
    have = c.where("digest < '8'").dropDuplicates(["digest"])
    return store.commit_payloads(have, c).groupBy("digest").agg(F.count("*").alias("n"))


@register(f"""WITH {CAPS} SELECT event_id, coalesce(p.url, 'kept') AS url, coalesce(p.html_title, 'old') AS title FROM caps LEFT JOIN (SELECT page_id, url, 'P' || page_id AS html_title FROM pages) p USING (page_id)""")
def curated_migration(spark, d):
    rows = caps(spark, d).select("event_id", F.col("page_id").alias("page"), F.lit("kept").alias("url"), F.lit("old").alias("title"), F.lit(0).cast("long").alias("ts_ms"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.concat(F.lit("P"), "page_id").alias("title"), F.lit(1).cast("long").alias("ts_ms"))
    return store.migrate_curated(rows, pages).select("event_id", "url", "title")


@register(f"""WITH {CAPS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'text of ' || event_id END AS text FROM caps""")
def pages_with_text(spark, d):
    c = caps(spark, d)
    texts = c.where("event_id % 2 = 0").select("url", "ts_ms", F.concat(F.lit("text of "), "event_id").alias("text"))
    return store.pages_with_text(c.select("event_id", "url", "ts_ms", F.lit("").alias("text")), texts).select("event_id", "text")


@register("SELECT (SELECT count(*) FROM customer) AS n_lists, (SELECT count(*) FROM pages) AS n_pages")
def store_counts(spark, d):
    return listing.store_counts(table(spark, d, "customer"), table(spark, d, "pages"))


@register(f"""WITH {CAPS} SELECT '{{"url":"' || url || '","status":' || status || CASE WHEN mime = 'warc/revisit' THEN '' ELSE ',"mime":"' || mime || '"' END || '}}' AS json FROM caps""")
def json_rows(spark, d):
    return listing.json_rows(caps(spark, d).select("url", "status", F.nullif("mime", F.lit("warc/revisit")).alias("mime")))


@register("SELECT CAST(0 AS BIGINT) AS n")
def store_cleared(spark, d):
    return store.cleared({"captures": caps(spark, d)})["captures"].agg(F.count("*").alias("n"))


# --- predicates ----------------------------------------------------------------------------------

@register(f"""WITH {CAPS} SELECT event_id, event_id % 4 <> 3 AS same FROM caps""")
def same_url(spark, d):
    """Equal, percent-encoded, a longer one for POST, and another for GET."""
    b = F.expr("case event_id % 4 when 0 then url when 1 then replace(url, '/', '%2F') else concat(url, '?q=1') end")
    return caps(spark, d).select("event_id", P.same_url(F.col("url"), b, F.when(F.expr("event_id % 4 = 2"), "POST")).alias("same"))


@register(f"""WITH {CAPS} SELECT event_id, k % 3 < 2 OR ts_ms % 1000 = 0 AS agrees FROM caps""")
def time_agreement(spark, d):
    wanted = F.expr("case k % 3 when 0 then ts_ms when 1 then ts_ms div 1000 * 1000 else ts_ms div 1000 * 1000 + 1000 * (case when ts_ms % 1000 = 0 then 0 else 1 end) end")
    return caps(spark, d).select("event_id", P.time_agrees(F.col("ts_ms"), wanted).alias("agrees"))


@register(f"""WITH {CAPS} SELECT event_id, k % 2 = 0 AS agrees FROM caps""")
def digest_agreement(spark, d):
    a, b = F.concat(F.lit("sha-256:"), "digest"), F.concat(F.lit("sha256:"), "digest", F.when(F.expr("k % 2 = 0"), "").otherwise("0"))
    return caps(spark, d).select("event_id", P.digest_agrees(a, b).alias("agrees"))


@register(f"""WITH {CAPS} SELECT event_id, status = 304 AS empty, starts_with(url, 'https://u1') OR starts_with(url, 'https://u2') AS ours, contains(url, 'view') OR contains(url, '7.') AS marked,
  status > 300 AS asked FROM caps""")
def url_predicates(spark, d):
    url = F.col("url")
    headers = F.when(F.col("status") > 400, F.create_map(F.lit("x-requested-with"), F.lit("XMLHttpRequest"))).otherwise(F.create_map(F.lit("accept"), F.lit("*/*")))
    ajax = P.is_ajax(headers, F.when(F.expr("status between 301 and 400"), "cors").otherwise("navigate"), F.lit(None).cast("string"))
    return caps(spark, d).select("event_id", P.null_body(F.col("status")).alias("empty"), P.starts_with_any(url, ["https://u1", "https://u2"]).alias("ours"), P.contains_any(url, ["view", "7."]).alias("marked"), ajax.alias("asked"))


@register(f"""WITH {CAPS} SELECT event_id, url FROM caps WHERE NOT (starts_with(url, 'https://u1') OR starts_with(url, 'https://u30.'))""")
def excluded_urls(spark, d):
    return listing.without_excluded(caps(spark, d), ["https://u1", "https://u30."]).select("event_id", "url")


@register(f"""WITH {CAPS} SELECT event_id, event_id % 3 < 2 AS has, url || '?a=1' AS stripped FROM caps""")
def range_queries(spark, d):
    asked = F.concat("url", F.expr("case event_id % 3 when 0 then '?a=1&range=0-99' when 1 then '?bytestart=5&byteend=9&a=1' else '?a=1' end"))
    return caps(spark, d).select("event_id", P.has_range_query(asked).alias("has"), P.strip_range_query(asked).alias("stripped"))


@register("""SELECT page_id, nth, regexp_matches(script, '\\b(window|self|document|location|top|parent|frames|opener|globalThis|this|eval|postMessage)\\b') AS uses FROM (
  SELECT page_id, unnest(s) AS script, generate_subscripts(s, 1) - 1 AS nth FROM (SELECT page_id, regexp_extract_all(html, '<script>(.*?)</script>', 1, 's') AS s FROM pages))""")
def script_relevance(spark, d):
    found = F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), 1)).alias("nth", "script")
    return table(spark, d, "pages").select("page_id", found).select("page_id", F.col("nth").cast("long").alias("nth"), P.uses_globals(F.col("script")).alias("uses"))


# --- lookups and joins ---------------------------------------------------------------------------

@register("""SELECT page_id FROM pages WHERE page_id % 5 = 3 AND page_id IN (SELECT o_custkey FROM orders)""")
def pages_by_state(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.expr("page_id % 5").alias("state"))
    return listing.pages_by(pages, ids=table(spark, d, "orders").select("o_custkey"), state=3).select(F.col("id").alias("page_id"))


@register(f"""WITH {REQS}, p AS (SELECT * FROM caps WHERE status = 200 AND mime = 'text/html'), e AS (
  SELECT r.req_id, r.url, r.ts_ms, c.page_id AS eid, c.ts_ms AS ets FROM (SELECT *, ts_ms - 999 AS low FROM reqs) r ASOF LEFT JOIN p c ON r.url = c.url AND r.low <= c.ts_ms
), a AS (SELECT e.*, c.page_id AS bid, c.ts_ms AS bts FROM e ASOF LEFT JOIN p c ON e.url = c.url AND e.ts_ms >= c.ts_ms),
b AS (SELECT a.*, c.page_id AS fid, c.ts_ms AS fts FROM a ASOF LEFT JOIN p c ON a.url = c.url AND a.ts_ms <= c.ts_ms)
SELECT req_id, CASE WHEN ets < ts_ms + 1000 THEN eid WHEN fid IS NULL OR ts_ms - bts <= fts - ts_ms THEN bid ELSE fid END AS page_id FROM b""")
def nearest_page_early(spark, d):
    pages = caps(spark, d).where("status = 200 and mime = 'text/html'")
    return lookup.nearest_page(reqs(spark, d), pages, CAPTURE_COLUMNS).select("req_id", F.col("hit.page_id").alias("page_id"))


_ORIG = """o AS (SELECT *, CASE WHEN k % 3 = 0 THEN regexp_replace(url, '/[a-z_]+$', '/view') ELSE url END AS orig_url, ts_ms - (k - 50) * 600000 AS orig_ts_ms FROM caps)"""


def _with_orig(spark, d):
    return caps(spark, d).withColumns({"orig_url": F.when(F.expr("k % 3 = 0"), F.regexp_replace("url", r"/[a-z_]+\z", "/view")).otherwise(F.col("url")), "orig_ts_ms": F.expr("ts_ms - (k - 50) * 600000")})


@register(f"""WITH {CAPS}, {_ORIG}, n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts_ms) AS o, mime = 'warc/revisit' OR coalesce({SKIP}, false) AS dropped FROM o),
r AS (SELECT event_id AS req_id, orig_url AS url, orig_ts_ms AS ts_ms FROM o WHERE mime = 'warc/revisit'),
f AS (SELECT r.*, c.o AS o0 FROM r ASOF LEFT JOIN n c ON r.url = c.url AND r.ts_ms <= c.ts_ms),
s AS (SELECT f.*, c.o AS o1, c.event_id AS fid FROM f ASOF LEFT JOIN (SELECT * FROM n WHERE NOT dropped) c ON f.url = c.url AND f.ts_ms <= c.ts_ms),
b AS (SELECT s.*, c.event_id AS bid FROM s ASOF LEFT JOIN (SELECT * FROM n WHERE NOT dropped) c ON s.url = c.url AND s.ts_ms >= c.ts_ms)
SELECT req_id AS event_id, CASE WHEN o1 - o0 < 16 THEN fid ELSE bid END AS original_id FROM b""")
def revisit_of_other_url(spark, d):
    """Revisits that name URL and time of their original, followed for two rounds."""
    return lookup.resolve_revisits(_with_orig(spark, d), CAPTURE_COLUMNS).select("event_id", F.col("hit.event_id").alias("original_id"))


@register(f"""WITH {REQS}, {_ORIG}, h AS (SELECT r.req_id, r.ts_ms, c.event_id, c.orig_url, c.orig_ts_ms FROM reqs r ASOF JOIN o c ON r.url = c.url AND r.ts_ms >= c.ts_ms),
m AS (SELECT h.*, c.event_id AS fid, coalesce(c.skip, false) AS fskip FROM h ASOF LEFT JOIN (SELECT *, {SKIP} AS skip FROM caps) c ON h.orig_url = c.url AND h.orig_ts_ms <= c.ts_ms),
p AS (SELECT *, orig_ts_ms + CASE WHEN fid IS NOT NULL AND fskip THEN 10000 ELSE 0 END AS probe FROM m),
g AS (SELECT p.*, c.event_id AS bid FROM p ASOF LEFT JOIN (SELECT * FROM caps WHERE NOT coalesce({SKIP}, false)) c ON p.orig_url = c.url AND p.probe >= c.ts_ms)
SELECT req_id, coalesce(CASE WHEN fid IS NOT NULL AND NOT fskip THEN fid ELSE bid END, event_id) AS event_id FROM g""")
def origin_followed(spark, d):
    """Hits that name an original give way to it."""
    c = _with_orig(spark, d)
    rows = lookup.union_rows(reqs(spark, d), c, [*CAPTURE_COLUMNS, "orig_url", "orig_ts_ms"], F.lit(False))
    found = lookup.carry(rows, "_key", "_t", "_cap", "hit").where("_req is not null and hit is not null").select("_req.*", "hit")
    better = lookup.follow_origin(found, c, [*CAPTURE_COLUMNS, "orig_url", "orig_ts_ms"], "req_id")
    return better.select("req_id", F.col("hit.event_id").alias("event_id"))


@register(f"""WITH {CAPS} SELECT event_id, CASE WHEN status = 304 THEN NULL WHEN k % 10 = 5 THEN '' ELSE 'b' || digest END AS body FROM caps WHERE status = 304 OR k % 10 <> 6""")
def payload_join(spark, d):
    """Payloads by digest: known empty ones need none, null-body statuses have none, rows without one go."""
    c = caps(spark, d)
    have = c.where("k % 10 not in (5, 6)").select("digest").distinct().select("digest", F.concat(F.lit("b"), "digest").cast("binary").alias("payload"))
    found = c.withColumn("digest", F.when(F.expr("k % 10 = 5"), lookup.EMPTY_DIGESTS[0]).otherwise(F.col("digest")))
    out = lookup.with_payload(found, have)
    return out.select("event_id", F.when(~P.null_body(F.col("status")), F.decode("payload", "UTF-8")).alias("body"))


@register(f"""WITH {CAPS}, h AS (SELECT event_id AS req_id, CASE WHEN k % 3 = 0 THEN event_id END AS own, CASE WHEN k % 2 = 0 THEN -event_id END AS other FROM caps)
SELECT req_id, coalesce(own, other) AS hit FROM h""")
def dependency_fallback(spark, d):
    """Hits of the own archive, else of those it depends on."""
    c = caps(spark, d)
    own = c.select(F.col("event_id").alias("req_id"), F.when(F.expr("k % 3 = 0"), F.col("event_id")).alias("hit"))
    other = c.where("k % 2 = 0").select(F.col("event_id").alias("req_id"), (-F.col("event_id")).alias("hit"))
    return blocks.first_archive(own, other)


@register(f"""WITH {CAPS}, a AS (SELECT user_id AS query_id, event_id FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0)
SELECT query_id, event_id FROM a UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 3 > 0 AND user_id NOT IN (SELECT query_id FROM a)""")
def cross_archive_search(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id")
    return blocks.search_archives(e.where("event_id % 3 = 0 and query_id % 2 = 0"), e.where("event_id % 3 > 0"))


@register("""WITH p AS (SELECT DISTINCT 'http://s' || (c_custkey % 50) || '.example/' AS url, c_mktsegment AS archive FROM customer),
r AS (SELECT s_suppkey AS req_id, 'http://' || CASE WHEN s_suppkey % 3 = 1 THEN 'www.' ELSE '' END || 's' || CASE WHEN s_suppkey % 3 = 2 THEN 'x' ELSE '' END || (s_suppkey % 50) || '.example/' AS url, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS crawl_id FROM supplier),
a AS (SELECT 'A' || n_nationkey AS name, n_regionkey * 5 AS crawl_id, n_nationkey % 2 = 0 AS has_seed FROM nation),
t AS (SELECT req_id, archive, 0 AS kind FROM r JOIN p USING (url) UNION ALL
  SELECT req_id, archive, 1 FROM r JOIN p ON r.url <> replace(r.url, '://www.', '://') AND p.url = replace(r.url, '://www.', '://') UNION ALL
  SELECT req_id, name, 2 FROM r JOIN (SELECT crawl_id, unnest(list_sort(list(name))[:3]) AS name FROM a WHERE has_seed GROUP BY crawl_id) USING (crawl_id) UNION ALL
  SELECT req_id, name, 3 FROM r, (SELECT unnest(list_sort(list(name))[:3]) AS name FROM a)),
b AS (SELECT req_id, min(kind) AS kind FROM t GROUP BY 1), o AS (SELECT DISTINCT req_id, archive, kind FROM t JOIN b USING (req_id, kind)),
n AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY archive) AS r FROM o)
SELECT req_id, archive, kind FROM n WHERE r <= 3""")
def archives_to_try(spark, d):
    pages = table(spark, d, "customer").selectExpr("concat('http://s', c_custkey % 50, '.example/') as url", "c_mktsegment as archive")
    asked = table(spark, d, "supplier").selectExpr(
        "s_suppkey as req_id", "concat('http://', case when s_suppkey % 3 = 1 then 'www.' else '' end, 's', case when s_suppkey % 3 = 2 then 'x' else '' end, s_suppkey % 50, '.example/') as url",
        "case when s_suppkey % 2 = 0 then s_nationkey end as crawl_id",
    )
    archives = table(spark, d, "nation").selectExpr("concat('A', n_nationkey) as name", "n_regionkey * 5 as crawl_id", "n_nationkey % 2 = 0 as has_seed")
    return blocks.archives_to_try(asked, pages, archives)


@register("SELECT 'a' || (l_orderkey % 5) AS archive, 'k' || l_suppkey AS prefix, count(*) AS asked FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2")
def blocks_to_load(spark, d):
    found = table(spark, d, "lineitem").selectExpr("concat('a', l_orderkey % 5) as archive", "concat('k', l_suppkey) as prefix", "l_suppkey % 3 = 0 as loaded")
    return blocks.blocks_to_load(found)


@register("""WITH t AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch' WHEN 1 THEN 'https://www.facebook.com/p' WHEN 2 THEN 'https://player.vimeo.com/video/1' ELSE 'https://other.example/' END AS site FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '"canAutoPlay":false,' ELSE '"canAutoPlay":true,' END || CASE page_id % 4 WHEN 1 THEN '"supportsDash":false,' ELSE '"supportsDash":true,' END ||
  CASE page_id % 4 WHEN 2 THEN '"__dash":1,' ELSE '"dash":1,' END || page_id AS body FROM t""")
def domain_rules(spark, d):
    apply = _udf("string", lambda text, url: R.apply_rules(text, url))
    site = F.expr("case page_id % 4 when 0 then 'https://www.youtube.com/watch' when 1 then 'https://www.facebook.com/p' when 2 then 'https://player.vimeo.com/video/1' else 'https://other.example/' end")
    body = F.concat(F.lit('"canAutoPlay":true,"supportsDash":true,"dash":1,'), "page_id")
    return table(spark, d, "pages").select("page_id", apply(body, site).alias("body"))


@register("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://new.example/' || user_id WHEN 1 THEN 'https://b.example/x?id=' || user_id END AS found FROM events""")
def url_patterns(spark, d):
    """Rewrites that a user gives as patterns; the first that changes the URL counts."""
    url = F.expr("case event_id % 3 when 0 then concat('https://old.example/', user_id) when 1 then concat('https://b.example/x/', user_id) else 'https://c.example/' end")
    return table(spark, d, "events").select("event_id", U.rewrite_by_patterns(url, [(r"//old\.", "//new."), (r"/x/([0-9]+)\z", "/x?id=$1")]).alias("found"))


# --- times and URLs ------------------------------------------------------------------------------

@register("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS ts14, strftime(ts, '%Y%m%d%H%M%S%g') AS ts17, epoch_us(ts) // 1000000 AS seconds FROM events""")
def time_stamps(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000")
    return table(spark, d, "events").select("event_id", D.iso_to_ts14(iso).alias("ts14"), D.iso_to_ts17(iso).alias("ts17"), D.ms_to_seconds(ms).alias("seconds"))


@register("""SELECT event_id, 'https://u' || user_id || '.example/' || CASE event_id % 8 WHEN 0 THEN 'a/b/c.html' WHEN 1 THEN 'c.html' WHEN 2 THEN 'a/c.html?x=1' WHEN 3 THEN 'a/b/p.html?q=2' WHEN 4 THEN 'c.html#f'
  WHEN 5 THEN 'a/b/' WHEN 6 THEN 'a/b/p.html?old=1#top' ELSE 'a/b/.hidden' END AS url FROM events""")
def resolved_urls(spark, d):
    """References of eight kinds against a base, in columns."""
    to = F.expr("case event_id % 8 when 0 then 'c.html' when 1 then '/c.html' when 2 then '../c.html?x=1' when 3 then '?q=2' when 4 then '../../../c.html#f' when 5 then './' when 6 then '#top' else '.hidden' end")
    base = F.concat(F.lit("https://u"), "user_id", F.lit(".example/a/b/p.html?old=1#frag"))
    return table(spark, d, "events").select("event_id", U.join_url(base, to).alias("url"))


@register("""SELECT event_id, 'https://u' || user_id || '.example/' || CASE event_id % 4 WHEN 0 THEN 'a/b/c.html' WHEN 1 THEN 'c.html' WHEN 2 THEN 'a/b/p.html?q=2' ELSE 'a%20b' END AS url FROM events""")
def referrer_urls(spark, d):
    to = F.expr("case event_id % 4 when 0 then 'c.html' when 1 then '/c.html' when 2 then '?q=2' else '/a b' end")
    return table(spark, d, "events").select("event_id", U.resolve(to, F.concat(F.lit("HTTPS://U"), "user_id", F.lit(".example:443/a/b/p.html"))).alias("url"))


@register(f"SELECT page_id, '{PREFIX}' || url AS url, url AS plain FROM pages")
def rewritten_back(spark, d):
    there = F.concat(F.lit(PREFIX), "url")
    return table(spark, d, "pages").select("page_id", there.alias("url"), U.unrewrite(there, PREFIX).alias("plain"))


@register("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://u' || user_id || '.example/' WHEN 1 THEN 'http://h.example/a%20b' END AS target FROM events""")
def canonical_redirects(spark, d):
    go = _udf("string", lambda url: U.canonical_redirect(url))
    url = F.expr("case event_id % 3 when 0 then concat('https://U', user_id, '.example:443') when 1 then 'http://h.example/a b' else concat('https://u', user_id, '.example/x') end")
    return table(spark, d, "events").select("event_id", go(url).alias("target"))


@register("""SELECT event_id, 'https://u' || user_id || '.test' || CASE WHEN event_id % 2 = 0 THEN ':8080/p' ELSE '/example' END AS url FROM events""")
def proxy_hosts(spark, d):
    url = F.expr("concat('http://u', user_id, '.example', case when event_id % 2 = 0 then ':8080/p' else '/example' end)")
    return table(spark, d, "events").select("event_id", U.upgrade_scheme(U.tld_swap(url, "example", "test")).alias("url"))


@register("""SELECT event_id, 'https://a.example/f' || CASE event_id % 3 WHEN 0 THEN '?__wb_method=POST&user=' || user_id || '&b=2' WHEN 1 THEN '?q=1&__wb_method=POST&user=' || user_id || '&s=x%20y'
  ELSE '?__wb_method=PUT&__wb_post_data=raw%3A' || user_id END AS url FROM events""")
def posted_urls(spark, d):
    e = table(spark, d, "events")
    url = F.expr("case event_id % 3 when 1 then 'https://a.example/f?q=1' else 'https://a.example/f' end")
    body = F.expr("""case event_id % 3 when 0 then concat('user=', user_id, '&b=2') when 1 then concat('{"user":', user_id, ',"s":"x y"}') else concat('raw:', user_id) end""")
    mime = F.expr("case event_id % 3 when 0 then 'application/x-www-form-urlencoded' when 1 then 'application/json' else 'text/plain' end")
    return e.select("event_id", U.post_urls(url, body, mime, F.expr("case event_id % 3 when 2 then 'PUT' else 'POST' end")).alias("url"))


@register("SELECT event_id, url FROM (SELECT event_id, 'https://u' || user_id || '.example.com/' || event_type AS url FROM events) WHERE url >= 'https://u1' AND url < 'https://u2'")
def prefix_bound(spark, d):
    """A prefix scan written as a range, as an ordered store reads it."""
    c = caps(spark, d)
    return c.where((F.col("url") >= "https://u1") & (F.col("url") < U.prefix_upper_bound("https://u1"))).select("event_id", "url")


@register("""SELECT event_id, 'attachment; filename*=UTF-8''''' || CASE event_id % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'f' || user_id || '.pdf' ELSE 'a%20b.txt' END AS header FROM events""")
def attachment_names(spark, d):
    url = F.expr("case event_id % 3 when 0 then 'https://a.example/' when 1 then concat('https://a.example/x/f', user_id, '.pdf?d=1#p') else 'https://a.example/a b.txt' end")
    return table(spark, d, "events").select("event_id", U.attachment_name(url).alias("header"))


@register("SELECT event_id, left(sha256(event_type || '|' || user_id), 12) AS id FROM events")
def short_ids(spark, d):
    return table(spark, d, "events").select("event_id", U.short_id(F.col("event_type"), F.col("user_id").cast("string"), size=12).alias("id"))


@register("SELECT doc_id, text FROM documents")
def charset_decoded(spark, d):
    """UTF-8 with and without a mark and UTF-16 of both orders come back as they were."""
    mark = {0: ("x'EFBBBF'", "UTF-8"), 1: ("x'FFFE'", "UTF-16LE"), 2: ("x'FEFF'", "UTF-16BE")}
    body = F.col("text").cast("binary")
    for k, (m, kind) in mark.items():
        body = F.when(F.expr(f"doc_id % 4 = {k}"), F.concat(F.expr(m), F.encode("text", kind))).otherwise(body)
    return table(spark, d, "documents").select("doc_id", X.decode_text(body, F.lit(None).cast("string")).alias("text"))


# --- fuzzy matching ------------------------------------------------------------------------------

@register("""SELECT event_id, CASE event_id % 4
  WHEN 0 THEN CAST(1 + 5 + 10 * length(CAST(user_id AS VARCHAR)) AS DOUBLE) / 11
  WHEN 1 THEN CAST(1 AS DOUBLE) / 11
  WHEN 2 THEN (1 + 5 + 10 - ln(3)) / 11
  ELSE (1 + 0.05 + 0.1 * length(CAST(user_id AS VARCHAR))) / 1.1 END AS score FROM events""")
def argument_similarity(spark, d):
    """Equal, missing, near in number, and equal under a name that hardly counts."""
    sim = _udf("double", lambda name, a, b: float(fuzzy_match.similarity([(name, a)], [(name, b)] if b is not None else [])))
    a = F.col("user_id").cast("string")
    b = F.expr("case event_id % 4 when 1 then cast(null as string) when 2 then cast(user_id + 2 as string) else cast(user_id as string) end")
    return table(spark, d, "events").select("event_id", sim(F.when(F.expr("event_id % 4 = 3"), "_n").otherwise("n"), a, b).alias("score"))


@register("""SELECT event_id, 'https://a.example/?id=' || user_id AS best FROM events""")
def best_of_candidates(spark, d):
    """Of four candidates the one with the same argument; 304s never, worse statuses later."""
    def best(user: str) -> str:
        found = fuzzy_match.best_match(f"https://a.example/?id={user}&x=1", [
            fuzzy_match.Candidate("https://a.example/?id=other"), fuzzy_match.Candidate(f"https://a.example/?id={user}&x=1", 304),
            fuzzy_match.Candidate(f"https://a.example/?id={user}"), fuzzy_match.Candidate(f"https://a.example/?id={user}&y=2", 404)])
        return found[0].url

    return table(spark, d, "events").select("event_id", _udf("string", best)(F.col("user_id").cast("string")).alias("best"))


@register("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(133 AS DOUBLE) ELSE CAST(33 AS DOUBLE) END AS score FROM events""")
def route_sets(spark, d):
    """Numbered arguments are compared as a set whose first places count most: the bonus alone."""
    def bonus(n: int) -> float:
        a = [("routes[0]", "/a"), ("routes[1]", "/b")]
        b = [("routes[0]", "/b"), ("routes[1]", "/a")] if n % 2 == 0 else [("routes[0]", "/c"), ("routes[1]", "/a")]
        return round(fuzzy_match.similarity(a, b, fuzzy_set=True) - (1 + 2 * 5) / 21, 6)

    return table(spark, d, "events").select("event_id", _udf("double", bonus)("event_id").alias("score"))


@register(f"""WITH p AS (SELECT page_id, url, split_part(url, '?', 1) AS bare FROM pages WHERE contains(url, '?')),
o AS (SELECT a.page_id AS req_id, min(b.url) AS url FROM p a JOIN p b USING (bare) WHERE a.url = b.url GROUP BY 1)
SELECT req_id, url AS hit_url FROM o""")
def fuzzy_ties(spark, d):
    """Every capture under three times that score alike: the first in key order is taken."""
    from palimpsest.operators.fuzzy import best_matches

    p = table(spark, d, "pages").where(F.contains("url", F.lit("?")))
    asked = p.select(F.col("page_id").alias("req_id"), F.concat("url", F.lit("&nothere=")).alias("url"))
    held = p.select("url", F.lit(200).alias("status"), F.explode(F.expr("array(5L, 1L, 9L)")).alias("ts_ms"))
    return best_matches(asked, held).where("hit_ts_ms = 1").select("req_id", "hit_url")


# --- markup --------------------------------------------------------------------------------------

_PAGE = """concat('<a href="', '/p', user_id, '">x</a><img srcset="/s', event_id, '.png 1x, /t.png 2x"><meta http-equiv="refresh" content="3; url=/r', user_id, '"><link rel="stylesheet" href="/c.css"><p>t</p>')"""


@register(f"""WITH e AS (SELECT event_id, user_id, '{PATH}' || 'https://u' || user_id || '.example' AS root, replace('{PATH}' || 'https://u' || user_id || '.example', 'mp_/', 'cs_/') AS css, replace('{PATH}' || 'https://u' || user_id || '.example', 'mp_/', 'im_/') AS pic FROM events)
SELECT event_id, '<a href="' || root || '/p' || user_id || '">x</a><img srcset="' || pic || '/s' || event_id || '.png 1x, ' || pic || '/t.png 2x"><meta http-equiv="refresh" content="3; url=' || root || '/r' || user_id ||
  '"><link rel="stylesheet" href="' || css || '/c.css"><p>t</p>' AS html FROM e""")
def page_attributes(spark, d):
    """Links, srcset, refresh and style sheet of made pages."""
    from palimpsest.functions.rewrite.html import page_rewriter

    base = F.concat(F.lit("https://u"), "user_id", F.lit(".example/d/p.html"))
    return _spread(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", page_rewriter(PREFIX)(F.expr(_PAGE), base).alias("html"))


@register("""SELECT event_id, '{"imports": {"m": "https://replay.example/coll/20200101000000mp_/https://a.example/m' || user_id || '.js"}}' AS json FROM events""")
def import_maps(spark, d):
    fix = _udf("string", lambda text, base: R.rewrite_importmap(text, PREFIX, base))
    text = F.concat(F.lit('{"imports": {"m": "https://a.example/m'), "user_id", F.lit('.js"}}'))
    return table(spark, d, "events").select("event_id", fix(text, F.lit("https://a.example/")).alias("json"))


@register("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'data:text/javascript;base64,' || base64(encode('f(' || user_id || ')//' )) ELSE 'plain' || user_id END AS src FROM events""")
def base64_scripts(spark, d):
    fix = _udf("string", lambda text: R.rewrite_script_base64(text, lambda script: script + "//"))
    src = F.when(F.expr("event_id % 2 = 0"), F.concat(F.lit("data:text/javascript;base64,"), F.base64(F.encode(F.concat(F.lit("f("), "user_id", F.lit(")")), "UTF-8")))).otherwise(F.concat(F.lit("plain"), "user_id"))
    return table(spark, d, "events").select("event_id", fix(src).alias("src"))


@register("""SELECT event_id, 'cb' || user_id || '({"dash_mpd":1});' AS body FROM events""")
def json_bodies(spark, d):
    fix = _udf("string", lambda text, url: R.rewrite_json(text, url))
    return table(spark, d, "events").select("event_id", fix(F.lit('old({"dash_mpd":1});'), F.concat(F.lit("https://a.example/?callback=cb"), "user_id")).alias("body"))


@register(f"""SELECT event_id, '{PATH}https://a.example/l' || user_id AS location, '"e"' AS etag, CAST(user_id AS VARCHAR) AS own, '{PREFIX}https://a.example/x' AS link FROM events""")
def response_headers(spark, d):
    """Whole header maps: locations and links rewritten, others renamed or kept."""
    kind = "struct<location: string, etag: string, own: string, link: string>"

    @F.pandas_udf(kind)
    def fix(user: pd.Series) -> pd.DataFrame:
        out = []
        for u in user:
            h = H.rewrite_headers({"Location": f"/l{u}", "ETag": '"e"', "X-Own": str(u), "Link": "<https://a.example/x>; rel=preload"}, PREFIX, "https://a.example/p")
            out.append((h["location"], h[H.OLD.lower() + "etag"], h["x-own"], h["link"][1:].partition(">")[0]))
        return pd.DataFrame(out, columns=["location", "etag", "own", "link"])

    return table(spark, d, "events").select("event_id", fix("user_id").alias("h")).select("event_id", "h.*")


@register("""SELECT event_id, 'import x from "https://replay.example/coll/20200101000000esm_/https://a.example/m' || user_id || '.js";' AS js FROM events""")
def module_imports(spark, d):
    from palimpsest.functions.rewrite.js import rewrite_imports

    fix = _udf("string", lambda text, base: rewrite_imports(text, PREFIX.replace("mp_/", "esm_/"), base))
    return table(spark, d, "events").select("event_id", fix(F.concat(F.lit('import x from "./m'), "user_id", F.lit('.js";')), F.lit("https://a.example/p.js")).alias("js"))


@register("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 412800 WHEN 1 THEN 921600 ELSE 100 + user_id END AS pixels, CASE event_id % 3 WHEN 1 THEN 2000000 ELSE 1000000 END AS rate FROM events""")
def media_limits(spark, d):
    from palimpsest.functions.rewrite.video import limits

    @F.pandas_udf("struct<pixels: long, rate: long>")
    def told(kind: pd.Series, user: pd.Series) -> pd.DataFrame:
        options = {0: lambda u: None, 1: lambda u: {"legacy": True}, 2: lambda u: {"max_pixels": 100 + u}}
        return pd.DataFrame([limits(options[k](u)) for k, u in zip(kind, user, strict=True)], columns=["pixels", "rate"])

    return table(spark, d, "events").select("event_id", told(F.expr("event_id % 3"), F.col("user_id")).alias("x")).select("event_id", "x.*")


@register("SELECT doc_id, text FROM documents")
def body_encodings(spark, d):
    """Gzip, deflate and chunked bodies come back as they were."""
    import gzip
    import zlib

    def packed(text: str, kind: int) -> bytes | None:
        if text is None:
            return None
        raw = text.encode()
        return [raw, gzip.compress(raw), zlib.compress(raw), b"%x\r\n%s\r\n0\r\n\r\n" % (len(raw), raw) if raw else b"0\r\n\r\n"][kind]

    kind = F.expr("doc_id % 4")
    body = _udf("binary", packed)("text", kind)
    out = X.decoded(body, F.when(kind == 1, "gzip").when(kind == 2, "deflate"), F.when(kind == 3, "chunked"))
    return table(spark, d, "documents").select("doc_id", F.decode(out, "UTF-8").alias("text"))


@register("""SELECT doc_id, nth, line FROM (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS nth FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def text_lines(spark, d):
    return adblock.lines_of(table(spark, d, "documents").select("doc_id", F.col("text"))).select("doc_id", F.col("line_no").alias("nth"), "line")


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/* Not in this archive: ' || url || ' */' WHEN 1 THEN '/* Not in this archive: ' || url || ' */' WHEN 2 THEN '{"error":"not_found","URL":"' || url || '"}'
  ELSE '<!doctype html><p>Not in this archive: ' || url || '</p>' END AS body FROM (SELECT event_id, 'https://u' || user_id || '.example/' AS url FROM events)""")
def missing_bodies(spark, d):
    kind = F.expr("case event_id % 4 when 0 then 'script' when 1 then 'style' when 2 then '' else 'document' end")
    return table(spark, d, "events").select("event_id", R.not_found_body(kind, F.concat(F.lit("https://u"), "user_id", F.lit(".example/"))).alias("body"))


_CHECKED = "((self.__replay_location && self.__replay_location(location, arguments)) || {}).href = "
#: Scripts and what becomes of them; U stands for a name.
_SCRIPTS = [
    ("a = eval;", "a = self.eval;"), ("var self = U;", "let self = U;"), ("w.postMessage(U)", "w.__replay_pm(self).postMessage(U)"), ("let location = U", "let location = U"),
    ("location = U", f"location = {_CHECKED}U"), ("return this;", "return __replay_this(this);"), ("x(this.location, U)", "x(__replay_this(this).location, U)"),
    ("})(this)", "})(__replay_this(this))"), ("U || this;", "U || __replay_this(this);"), ("async import(U)", "async import(U)"), ("import(U)", "__replay_import(null, U)"),
    ('"x = this; location = U" // return this', '"x = this; location = U" // return this'), ("my.location = U.eval(this.x)", "my.location = U.eval(this.x)"),
    ("f()\n\nthis.top", "f()\n\n;__replay_this(this).top"), ("class A {}; location = U", f"class A {{}}; location = {_CHECKED.replace('arguments', '[]')}U"), ("x = this", "x = __replay_this(this)"),
]


def _case(column: int) -> str:
    """SQL of one side of _SCRIPTS by event_id."""
    whens = " ".join(f"WHEN {k} THEN '" + pair[column].replace("'", "''").replace("\n", "~") + "'" for k, pair in enumerate(_SCRIPTS))
    return f"replace(replace(CASE event_id % {len(_SCRIPTS)} {whens} END, '~', chr(10)), 'U', 'u' || user_id)"


@register(f"SELECT event_id, {_case(1)} AS js FROM events")
def script_rules(spark, d):
    """Each rule of scripts, and code that looks like one."""
    from palimpsest.functions.rewrite.js import replaced

    return table(spark, d, "events").select("event_id", _udf("string", lambda text: replaced(text))(F.expr(_case(0))).alias("js"))


@register(f"""WITH e AS (SELECT event_id, 'https://u' || user_id || '.example' AS root FROM events)
SELECT event_id, '<iframe src="/coll/20200101000000if_/' || root || '/d.pdf" type="application/pdf">x</iframe><iframe src="/coll/20200101000000if_/' || root || '/e.bin" sandbox="allow-same-origin allow-scripts"></iframe><img src="{PATH}' || root ||
  '/i.png" type="image/png"><object data="/coll/20200101000000oe_/' || root || '/o.x">y</object><img src="{PATH}' || root || '/v.svg" type="image/svg+xml"></img>' AS html FROM e""")
def object_conversion(spark, d):
    from palimpsest.functions.rewrite.html import page_rewriter

    page = '<object data="/d.pdf" type="application/pdf">x</object><embed src="/e.bin"><embed src="/i.png" type="image/png"><object data="/o.x">y</object><object data="/v.svg" type="image/svg+xml"></object>'
    return _spread(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", page_rewriter(PREFIX)(F.lit(page), F.concat(F.lit("https://u"), "user_id", F.lit(".example/p"))).alias("html"))


@register("""SELECT event_id, '<p>loadOrderID&quot;&#x3A;' || CASE WHEN event_id % 2 = 0 THEN user_id ELSE 123 END || '</p>' AS html FROM events""")
def text_node_rule(spark, d):
    from palimpsest.functions.rewrite.html import page_rewriter

    base = F.concat(F.lit("https://a.example/?x"), F.when(F.expr("event_id % 2 = 0"), "&:loadOrderID=").otherwise("&other="), "user_id")
    return _spread(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", page_rewriter(PREFIX)(F.lit("<p>loadOrderID&quot;&#x3A;123</p>"), base).alias("html"))


@register("""SELECT event_id, '<iframe src="https://u' || user_id || '.test/f"></iframe><a href="https://u' || user_id || '.example/l">x</a><script>this.location</script>' AS html FROM events""")
def proxied_pages(spark, d):
    """Pages replayed on another host: frames move, links and scripts stay."""
    from palimpsest.functions.rewrite.html import ProxyPageRewriter

    fix = _udf("string", lambda text, base: ProxyPageRewriter(base, "example", "test").run(text))
    page = F.concat(F.lit('<iframe src="https://u'), "user_id", F.lit('.example/f"></iframe><a href="https://u'), "user_id", F.lit('.example/l">x</a><script>this.location</script>'))
    return _spread(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", fix(page, F.lit("https://a.example/")).alias("html"))


# --- integrity, statistics, streams --------------------------------------------------------------

@register("""SELECT 'f' || doc_id AS id, 'sha256:' || sha256(coalesce(text, '')) AS expected, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS matched FROM documents""")
def digest_manifest(spark, d):
    """Files as listed, changed and absent."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.concat(F.lit("sha256:"), F.sha2(t, 256)).alias("hash"), F.concat(t, F.when(F.expr("doc_id % 3 = 1"), "!").otherwise("")).cast("binary").alias("payload"), "doc_id")
    return integrity.check_manifest(docs.select("path", "hash"), docs.where("doc_id % 3 < 2").select("path", "payload"))


@register("SELECT c_custkey, 'sha256:' || sha256(c_name) AS id FROM customer")
def archive_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", integrity.name_hash(F.col("c_name")).alias("id"))


@register("""SELECT event_id, 'u' || (user_id - user_id % 8) AS top FROM events""")
def referrer_chains(spark, d):
    """Each user was sent by the one before, up to the next multiple of eight: at most seven steps."""
    r = table(spark, d, "events").selectExpr("event_id", "concat('u', user_id) as url", "case when user_id % 8 > 0 then concat('u', user_id - 1) end as referrer", "user_id")
    every = spark.range(0, 2000).selectExpr("cast(null as long) as event_id", "concat('u', id) as url", "case when id % 8 > 0 then concat('u', id - 1) end as referrer", "id as user_id")
    return stats.referrer_top(r.unionByName(every), levels=8).where("event_id is not null").select("event_id", "top")


@register("""SELECT date_trunc('hour', ts) AS start, page AS client, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT ts, event_id % 13 AS page FROM events) GROUP BY 1, 2""")
def client_window_stats(spark, d):
    from palimpsest.streaming.access import client_windows

    hits = table(spark, d, "events").select("ts", F.expr("event_id % 13").alias("client"))
    return client_windows(hits, width="1 hour")


@register("""SELECT c_custkey AS id, c_name AS title FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE contains(lower(c_name), '1')) WHERE n > 25 AND n <= 50""")
def page_search(spark, d):
    """The second page of a search over titles."""
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_custkey").alias("ts_ms"))
    return listing.pages_matching(pages, "1", page=2, size=25).select("id", "title")


@register("""SELECT 'https://e.example/' || page_id AS url, 1704067200000 + page_id AS ts_ms, html AS text FROM pages WHERE html <> ''""")
def text_index(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("https://e.example/"), "page_id").alias("url"), F.lit("t").alias("title"), (F.lit(1704067200000) + F.col("page_id")).alias("ts_ms"), F.col("html").alias("text"))
    return listing.text_index(pages).select("url", "ts_ms", "text")


@register("""SELECT event_id, event_id % 5 IN (0, 1) AS changed FROM events""")
def script_types(spark, d):
    """Which kinds of scripts are code."""
    from palimpsest.functions.rewrite.html import PageRewriter

    changed = _udf("boolean", lambda kind: PageRewriter(PREFIX, "https://a.example/").script(kind, "window.x = 1") != "window.x = 1")
    return table(spark, d, "events").select("event_id", changed(F.expr("element_at(array('', 'text/javascript', 'application/json', 'text/template', 'speculationrules'), cast(1 + event_id % 5 as int))")).alias("changed"))


@register("""SELECT event_id, 'https://a.example/x.js' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '?v=' || repeat('1', 5000) END AS canon FROM events""")
def length_guards(spark, d):
    """Rules are not tried on very long URLs."""
    from palimpsest.operators.fuzzy import routed

    url = F.concat(F.lit("https://a.example/x.js?v="), F.expr("repeat('1', case when event_id % 2 = 0 then 10 else 5000 end)"))
    return table(spark, d, "events").select("event_id", routed(url)["canon"].alias("canon"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '.warc.gz' WHEN 1 THEN '.wacz' WHEN 2 THEN '.cdxj' END AS ending FROM events""")
def known_extensions(spark, d):
    name = F.expr("concat('https://a.example/f', user_id, element_at(array('.WARC.GZ?x=1', '.wacz#p', '.cdxj', '.txt'), cast(1 + event_id % 4 as int)))")
    return table(spark, d, "events").select("event_id", _udf("string", lambda n: files.known_extension(n))(name).alias("ending"))


@register("""SELECT c_custkey, c_name = 'Customer#000000001' AS named, CASE WHEN c_name = 'Customer#000000001' THEN 'new' ELSE c_mktsegment END AS title, CASE WHEN c_name = 'Customer#000000001' THEN 'd' END AS about,
  CASE WHEN c_name = 'Customer#000000002' THEN 'secret' END AS auth FROM customer""")
def collection_metadata(spark, d):
    """One collection's metadata merged, another's request headers set."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.create_map(F.lit("title"), "c_mktsegment").alias("metadata"), F.lit(None).cast("map<string,string>").alias("headers"))
    c = collections.update_auth(collections.merge_metadata(c, "Customer#000000001", {"title": "new", "desc": "d"}), "Customer#000000002", {"Authorization": "secret"})
    return c.select("c_custkey", (F.col("name") == "Customer#000000001").alias("named"), F.col("metadata")["title"].alias("title"), F.col("metadata")["desc"].alias("about"), F.col("headers")["Authorization"].alias("auth"))


@register("""SELECT doc_id, 'datapackageHash' AS id, doc_id % 2 = 0 AS matched FROM documents""")
def digest_records(spark, d):
    """Signed digest files: the hash of the manifest beside them."""
    import json

    @F.pandas_udf("array<struct<id: string, matched: boolean>>")
    def told(told_hash: pd.Series, manifest: pd.Series) -> pd.Series:
        return pd.Series([[{"id": i, "matched": m} for i, _, m in integrity.digest_record(json.dumps({"hash": h}), t.encode())] for h, t in zip(told_hash, manifest, strict=True)])

    t = F.coalesce("text", F.lit(""))
    right = F.concat(F.lit("sha256:"), F.sha2(F.concat(t, F.when(F.expr("doc_id % 2 = 0"), "").otherwise("!")), 256))
    return table(spark, d, "documents").select("doc_id", F.explode(told(right, t)).alias("x")).select("doc_id", "x.*")


@register("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS hash FROM documents")
def payload_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", integrity.payload_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


OWN = set(QUERIES)
