"""HAR documents as tables: captures of their entries, pages that finished loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIRS = "array<struct<name: string, value: string>>"
_HAR = f"""log struct<
  pages: array<struct<id: string, title: string, startedDateTime: string, pageTimings: struct<onLoad: double>>>,
  entries: array<struct<pageref: string, startedDateTime: string,
    request: struct<url: string, method: string, headers: {_PAIRS}>,
    response: struct<status: int, headers: {_PAIRS}, content: struct<text: string, encoding: string, mimeType: string>>>>>"""


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """(path, har) of HAR files, one document a file, parsed by a fixed schema (SC12)."""
    texts = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse_har(texts)


def parse_har(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("har", F.from_json(text, _HAR)).drop(text)


def _ms(iso):  # noqa: ANN001, ANN202
    return F.unix_millis(F.try_to_timestamp(iso))


def har_captures(hars: DataFrame) -> DataFrame:
    """Captures of entries with a body, base64 or plain (SC12); other columns of ``hars`` stay."""
    keep = [c for c in hars.columns if c != "har"]
    e = hars.select(*keep, F.explode("har.log.entries").alias("e")).where("e.response.content.text is not null")
    content = F.col("e.response.content")
    body = F.when(content["encoding"] == "base64", F.unbase64(content["text"])).otherwise(F.encode(content["text"], "UTF-8"))
    headers = F.map_from_entries(F.transform(F.array_distinct(F.transform("e.response.headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))), lambda h: F.struct(h["name"], h["value"])))
    return e.select(
        *keep, F.substring_index("e.request.url", "#", 1).alias("url"), _ms(F.col("e.startedDateTime")).alias("ts_ms"),
        F.coalesce(F.nullif("e.response.status", F.lit(0)), F.lit(200)).alias("status"), F.substring_index(F.coalesce(content["mimeType"], F.lit("")), ";", 1).alias("mime"),
        F.coalesce("e.request.method", F.lit("GET")).alias("method"), F.col("e.pageref").alias("page_id"), headers.alias("resp_headers"), body.alias("payload"),
    )


def har_pages(hars: DataFrame) -> DataFrame:
    """Pages that finished loading, under their title's URL or that of their first entry."""
    keep = [c for c in hars.columns if c != "har"]
    first = F.element_at(F.filter("har.log.entries", lambda e: e["pageref"] == F.col("p.id")), 1)
    p = hars.select(*keep, "har", F.explode("har.log.pages").alias("p")).where("coalesce(p.pageTimings.onLoad, 0) <> 0")
    url = F.when(F.col("p.title").startswith("http:") | F.col("p.title").startswith("https:"), F.col("p.title")).otherwise(F.when(F.exists("har.log.entries", lambda e: e["pageref"] == F.col("p.id")), first["request"]["url"]))
    out = p.select(*keep, F.col("p.id").alias("id"), url.alias("url"), F.nullif("p.title", F.lit("")).alias("title"), _ms(F.col("p.startedDateTime")).alias("ts_ms"))
    return out.where("url is not null").withColumn("title", F.coalesce("title", "url"))
