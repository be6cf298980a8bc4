"""Queries that write captures as archive files and read them back, with oracles over the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.inventory import QUERIES as _OTHERS
from palimpsest.plans.views import CAPS, caps
from palimpsest.session import shared_folder, table
from palimpsest.sources import files, indexes, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        assert f.__name__ not in _OTHERS
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Pages and captures of a file, and pages of a batch that is read.
_PAGES, _CAPTURES, _BATCH = 4_000, 100_000, 1_000


def _files_for(rows: DataFrame, least: int, each: int) -> int:
    """Files that rows are dealt to: as many as keep a file, and so a task, at one size."""
    return max(least, -(-rows.count() // each))


def _written(spark: SparkSession, d: str, whole: int | None = None) -> tuple[DataFrame, str]:
    """Captures as WARC files: requests before or after their responses, HEAD requests, revisits of
    other times and of themselves. As many files as captures need, or ``whole`` ones."""
    rows = caps(spark, d).select(
        F.concat("url", F.lit("/"), "event_id").alias("url"), "ts_ms", "status", "mime", F.concat(F.lit("body "), F.repeat(F.col("digest"), F.expr("cast(event_id % 40 as int)"))).cast("binary").alias("payload"),
        F.when(F.expr("k % 13 = 0"), "HEAD").otherwise("GET").alias("method"), F.when(F.col("mime") == "warc/revisit", F.concat("url", F.lit("/"), "event_id")).alias("orig_url"),
        F.expr("case when k % 20 = 19 then ts_ms else ts_ms - 1000 end").alias("orig_ts_ms"), F.when(F.expr("event_id % 3 > 0 or mime = 'warc/revisit'"), F.concat(F.lit("sha256:"), "digest")).alias("digest"), F.expr("event_id % 2 = 0").alias("request_first"), "event_id",
    )
    folder = _folder(spark, "warc")
    info = {"title": "T", "desc": "D", "pages": [{"id": "1", "url": "https://p.example/", "title": "P", "timestamp": "20240101000000"}]}
    return warc.write_warc(rows.repartition(_files_for(rows, 3, _CAPTURES), "event_id"), folder, info, whole), folder


_KEPT = """w AS (SELECT event_id, url || '/' || event_id AS url, ts_ms, CASE WHEN mime = 'warc/revisit' THEN 200 ELSE status END AS status, mime,
  CASE WHEN mime <> 'warc/revisit' THEN 'body ' || repeat(digest, CAST(event_id % 40 AS INTEGER)) END AS body, digest FROM caps
  WHERE CASE WHEN mime = 'warc/revisit' THEN k % 20 <> 19 ELSE k % 13 <> 0 END)"""
_DIGEST = "CASE WHEN mime = 'warc/revisit' OR event_id % 3 > 0 THEN 'sha256:' || digest ELSE 'sha-256:' || sha256(body) END"


@register(f"WITH {CAPS}, {_KEPT} SELECT url, ts_ms, status, mime, {_DIGEST} AS digest, body FROM w")
def warc_scan(spark, d):
    warc.register(spark)
    rows = spark.read.format("warc").load(_written(spark, d)[1])
    return rows.select("url", "ts_ms", "status", "mime", "digest", F.decode("payload", "UTF-8").alias("body"))


@register(f"WITH {CAPS}, {_KEPT} SELECT url, ts_ms, status, mime, {_DIGEST} AS digest FROM w")
def warc_index_in_ranges(spark, d):
    """Index only, each file read by many tasks that begin inside it."""
    warc.register(spark)
    rows = spark.read.format("warc").option("payload", "false").option("splitbytes", "20000").load(_written(spark, d)[1])
    return rows.select("url", "ts_ms", "status", "mime", "digest")


@register(f"WITH {CAPS}, {_KEPT} SELECT url, length(body) AS n_body FROM w WHERE body IS NOT NULL")
def warc_record_reads(spark, d):
    """Each record alone, by the range that the index names."""
    warc.register(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [warc.capture(warc.read_record(*x), None) for x in zip(b["path"], b["start"], b["length"], strict=True)]
            yield pd.DataFrame({"url": [r["url"] for r in out], "n_body": [len(r["payload"]) for r in out]})

    index = spark.read.format("warc").option("payload", "false").load(_written(spark, d)[1])
    return index.where("kind = 'response'").select("path", "start", "length").mapInPandas(read, "url string, n_body long")


@register("SELECT CAST(3 AS BIGINT) AS n, 'T' AS title, 'https://p.example/' AS url")
def warc_info(spark, d):
    """Title and pages that the files' first records tell."""
    warc.register(spark)
    rows = warc.info_rows(spark.read.format("warc").option("infoonly", "true").load(_written(spark, d, 3)[1]))
    return rows.select("title", F.explode("pages").alias("p")).groupBy("title", F.col("p.url").alias("url")).agg(F.count("*").alias("n"))


def _packed(spark: SparkSession, d: str, whole: int | None = None) -> tuple[DataFrame, str]:
    folder = _folder(spark, "wacz")
    written, _ = _written(spark, d, whole)
    return indexes.write_wacz(written, folder, "T"), folder


@register(f"WITH {CAPS}, {_KEPT} SELECT url, ts_ms, mime, body FROM w")
def wacz_captures(spark, d):
    """WARC members of archives, read in place."""
    rows = indexes.read_wacz(spark, _packed(spark, d)[1])["captures"]
    return rows.select("url", "ts_ms", "mime", F.decode("payload", "UTF-8").alias("body"))


@register(f"WITH {CAPS}, {_KEPT} SELECT url, ts_ms // 1000 * 1000 AS ts_ms, status, mime, 'data.warc.gz' AS member FROM w")
def wacz_index(spark, d):
    return indexes.read_wacz(spark, _packed(spark, d)[1])["index"].select("url", "ts_ms", "status", "mime", F.col("source.path").alias("member"))


@register(f"WITH {CAPS}, {_KEPT} SELECT url, ts_ms FROM w WHERE mime = 'text/html'")
def wacz_pages(spark, d):
    return indexes.read_wacz(spark, _packed(spark, d)[1])["pages"].select("url", "ts_ms")


@register("SELECT member, 'leaf' AS kind, CAST(3 AS BIGINT) AS n, CAST(CASE WHEN member = 'datapackage.json' THEN 0 ELSE 3 END AS BIGINT) AS n_whole FROM (VALUES ('archive/data.warc.gz'), ('indexes/index.cdxj'), ('pages/pages.jsonl'), ('datapackage.json')) t(member)")
def wacz_manifests(spark, d):
    """Members of archives, and how many have the bytes that the manifest tells."""
    archives, _ = _packed(spark, d, 3)
    listed = indexes.manifests(archives)

    @F.pandas_udf("string")
    def hashed(path: pd.Series, member: pd.Series) -> pd.Series:
        return pd.Series(["sha256:" + files.member_digest(p, m) for p, m in zip(path, member, strict=True)])

    told = listed.withColumn("whole", F.coalesce(hashed("path", "member") == F.col("hash"), F.lit(False)))
    return told.groupBy("member", "kind").agg(F.count("*").alias("n"), F.count_if("whole").alias("n_whole"))


@register("""SELECT 'https://u' || user_id || '.example.com/' || event_type || '/h' AS url, epoch_us(ts) // 3600000000 AS ts_ms, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def incremental_ingest(spark, d):
    """Files of captures taken up by a stream, batch by batch; of a repeated capture the last stays."""
    from palimpsest.streaming.access import ingest, ingested

    base = _folder(spark, "ingest")
    rows = table(spark, d, "events").select(
        F.concat(F.lit("https://u"), "user_id", F.lit(".example.com/"), "event_type", F.lit("/h")).alias("url"), F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_ms"),
        "event_id", F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.col("event_id").alias("seq"),
    )
    rows.repartition(4).write.parquet(f"{base}/in")
    ingest(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/check", files_per_batch=1).awaitTermination()
    return ingested(spark, f"{base}/out").select("url", "ts_ms", "event_id")


@register("SELECT page_id, html FROM pages")
def nested_archives(spark, d):
    """Members of an archive inside an archive, each read by its path."""
    import zipfile

    base = _folder(spark, "nested")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"{base}/o{TaskContext.get().partitionId()}.zip"
        held = f"{name}.{TaskContext.get().taskAttemptId()}"
        with files.create_file(held) as f, zipfile.ZipFile(f, "w") as outer:
            # the inner archive goes straight into the outer one, stored as it is
            with outer.open("in.zip", "w", force_zip64=True) as member, zipfile.ZipFile(member, "w", zipfile.ZIP_DEFLATED) as z:
                for b in batches:
                    for i, t in zip(b["page_id"], b["html"], strict=True):
                        if t is not None:
                            z.writestr(f"p/{i}.html", t.encode())
                    yield pd.DataFrame({"page_id": b["page_id"], "path": [None if t is None else f"{name}#!/in.zip#!/p/{i}.html" for i, t in zip(b["page_id"], b["html"], strict=True)]})
        files.move_file(held, name)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), _BATCH):
                part = b.iloc[at : at + _BATCH]
                texts = files.read_members(p for p in part["path"] if p is not None)
                yield pd.DataFrame({"page_id": part["page_id"], "html": [None if p is None else next(texts).decode() for p in part["path"]]})

    rows = table(spark, d, "pages").select("page_id", "html")
    packed = rows.repartition(_files_for(rows, 3, _PAGES), "page_id").mapInPandas(pack, "page_id long, path string")
    shared_folder(spark)
    return packed.checkpoint(eager=True).mapInPandas(read, "page_id long, html string")


def _streamed(spark: SparkSession, rows: DataFrame, plan, name: str) -> DataFrame:  # noqa: ANN001
    """What a streaming plan makes of ``rows``, read from files until there are no more."""
    base = _folder(spark, name)
    rows.repartition(4).write.parquet(f"{base}/in")
    stream = plan(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@register("""SELECT 'c' || (event_id % 7) AS client, event_type AS url, row_number() OVER (PARTITION BY event_id % 7, event_type ORDER BY ts) - 1 AS skip FROM events""")
def streamed_repeat_counts(spark, d):
    """How often a client asked for a URL before, by a stream that keeps a count for each."""
    from palimpsest.streaming.access import repeat_counts

    rows = table(spark, d, "events").select(F.expr("concat('c', event_id % 7)").alias("client"), F.col("event_type").alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, rows, repeat_counts, "repeats").select("client", "url", "skip")


@register("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_id % 5 AS client, count(*) AS n FROM events GROUP BY 1, 2)
SELECT epoch_us(start) AS start_us, client, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def streamed_client_windows(spark, d):
    """Windows that the watermark has closed."""
    from palimpsest.streaming.access import client_windows

    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.expr("event_id % 5").alias("client"))
    return _streamed(spark, rows, lambda s: client_windows(s, width="1 hour"), "windows").select(F.unix_micros("start").alias("start_us"), "client", "n")
