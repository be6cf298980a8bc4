"""Archive views over the driver's tables, in Spark and as DuckDB SQL.

``caps`` are captures and ``reqs`` requests derived from ``events``; both
engines compute them, and each formula uses integers and hashes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table

CAPTURE_COLUMNS = ["event_id", "ts_ms", "status", "mime", "digest", "page_id"]


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000")
    rows = e.select("event_id", "user_id", "event_type", ms.alias("ts_ms"), k.alias("k"))
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/"), F.col("event_type"))
    kind = F.expr("k % 20")
    rows = rows.withColumns({
        "url": url,
        "status": F.when(kind == 0, 503).when(kind == 1, 302).when(kind == 2, 404).when(kind == 3, 304).otherwise(200),
        "mime": F.when(F.expr("k % 10 = 9"), "warc/revisit").when(F.col("event_type").isin("view", "purchase"), "text/html")
        .when(F.col("event_type") == "click", "application/json").when(F.col("event_type") == "signup", "text/css").otherwise("image/png"),
        "digest": F.sha2(F.concat("event_type", F.lit("-"), F.col("k").cast("string")), 256),
        "page_id": F.expr("event_id div 10"),
    })
    location = F.when(kind == 1, F.when(F.expr("(k div 20) % 2 = 0"), F.col("url")).otherwise(F.concat("url", F.lit("/next"))))
    return rows.select("event_id", "url", "ts_ms", "k", "status", "mime", "digest", "page_id", location.alias("location"))


def reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture asked for again, at a time shifted by k - 50 hours."""
    c = caps(spark, sf_dir)
    return c.select(F.col("event_id").alias("req_id"), "url", (F.col("ts_ms") + (F.col("k") - 50) * 3_600_000).alias("ts_ms"))


CAPS = """caps AS (
  SELECT event_id, url, ts_ms, k, status, mime, digest, page_id,
         CASE WHEN k % 20 = 1 THEN CASE WHEN (k // 20) % 2 = 0 THEN url ELSE url || '/next' END END AS location
  FROM (
    SELECT event_id, 'https://u' || user_id || '.example.com/' || event_type AS url, epoch_us(ts) // 1000 AS ts_ms, k,
           CAST(CASE k % 20 WHEN 0 THEN 503 WHEN 1 THEN 302 WHEN 2 THEN 404 WHEN 3 THEN 304 ELSE 200 END AS INTEGER) AS status,
           CASE WHEN k % 10 = 9 THEN 'warc/revisit' WHEN event_type IN ('view', 'purchase') THEN 'text/html'
                WHEN event_type = 'click' THEN 'application/json' WHEN event_type = 'signup' THEN 'text/css' ELSE 'image/png' END AS mime,
           sha256(event_type || '-' || k) AS digest, event_id // 10 AS page_id
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
  )
)"""
REQS = CAPS + """, reqs AS (
  SELECT event_id AS req_id, url, ts_ms + (k - 50) * 3600000 AS ts_ms FROM caps
)"""
#: Whether a capture is passed over, without and with the 5xx rule.
SKIP = "(status BETWEEN 300 AND 399 AND (location IS NULL OR location = url))"
SKIP5 = f"({SKIP} OR status >= 500)"
