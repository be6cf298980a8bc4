"""Range scans and keyset listings over captures and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.predicates import mime_in


def exact(captures: DataFrame, url: str) -> DataFrame:
    return captures.where(F.col("url") == url)


def prefix(captures: DataFrame, start: str) -> DataFrame:
    return captures.where(F.col("url").startswith(start))


def host(captures: DataFrame, origin: str) -> DataFrame:
    return captures.where(F.col("url").startswith(origin.rstrip("/") + "/"))


def url_page(captures: DataFrame, rows: DataFrame, mimes: str = "", count: int = 1000, from_url: str = "", from_ts: int | None = None) -> DataFrame:
    """A page of ``rows`` in (url, ts_ms) order after a key, by mime prefixes."""
    if from_url:
        after = F.col("url") > from_url
        rows = rows.where(after | ((F.col("url") == from_url) & (F.col("ts_ms") > (from_ts or 0))))
    return rows.where(mime_in(F.col("mime"), mimes)).orderBy("url", "ts_ms").limit(count)


def mime_page(captures: DataFrame, mimes: str, count: int = 100, from_mime: str = "", from_status: int = 0, from_url: str = "") -> DataFrame:
    """A page in (mime, status, url) order after a key; rows without mime or status are in no index."""
    rows = captures.where("mime is not null and status is not null").where(mime_in(F.col("mime"), mimes))
    if from_mime:
        key = (F.col("mime") > from_mime) | ((F.col("mime") == from_mime) & ((F.col("status") > from_status) | ((F.col("status") == from_status) & (F.col("url") > from_url))))
        rows = rows.where(key)
    return rows.orderBy("mime", "status", "url", "ts_ms").limit(count)


def match_any(captures: DataFrame, column: str, keys: DataFrame, as_prefix: bool = False) -> DataFrame:
    """Rows whose column is one of the keys, or starts with one.

    Prefixes are met by equi-joins on the first characters, one for each
    length that occurs among the keys; never by comparing all with all.
    """
    k = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    if not as_prefix:
        return captures.join(k, captures[column] == k["_key"], "left_semi")
    lengths = [r[0] for r in k.select(F.length("_key")).distinct().collect()]  # few lengths
    if not lengths:
        return captures.limit(0)
    heads = F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in sorted(lengths)])
    probe = captures.withColumn("_id", F.monotonically_increasing_id()).withColumn("_heads", F.array_compact(heads))
    cols = captures.columns
    hit = probe.select("*", F.explode("_heads").alias("_key")).join(k, "_key", "left_semi")
    return hit.dropDuplicates(["_id"]).select(*cols)


def result_row(captures: DataFrame) -> DataFrame:
    """url, ISO date, 14-digit ts, mime and status with defaults (F1)."""
    from palimpsest.functions.timestamps import ms_to_ts14

    t = ms_to_ts14(F.col("ts_ms"))
    part = lambda a, n: F.substring(t, a, n)
    iso = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("."), F.lpad(F.pmod("ts_ms", F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))
    return captures.select("url", iso.alias("date"), t.alias("ts"), F.coalesce("mime", F.lit("")).alias("mime"), F.coalesce("status", F.lit(0)).alias("status"))


def of_pages(captures: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Captures of many pages."""
    return captures.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")


def timestamps_of(captures: DataFrame, url: str) -> DataFrame:
    return exact(captures, url).select("ts_ms").orderBy("ts_ms")


def pages_matching(pages: DataFrame, search: str = "", page: int = 1, size: int = 25, keys: tuple[str, ...] = ("url", "title", "text")) -> DataFrame:
    """One page of pages that contain the search text (SC27, T6)."""
    if search:
        hit: Column = F.lit(False)
        for k in keys:
            if k in pages.columns:
                hit = hit | F.coalesce(F.contains(F.lower(k), F.lit(search.lower())), F.lit(False))
        pages = pages.where(hit)
    return pages.orderBy("ts_ms", "id").offset((page - 1) * size).limit(size)


def pages_by(pages: DataFrame, url: str | None = None, ids: DataFrame | None = None, state: int | None = None) -> DataFrame:
    """Pages of a URL, of given ids (a table), of a state, or all."""
    if url is not None:
        pages = pages.where(F.col("url") == url)
    if ids is not None:
        pages = pages.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")
    return pages if state is None else pages.where(F.col("state") == state)


def store_counts(lists: DataFrame, pages: DataFrame) -> DataFrame:
    """Numbers of page lists and of pages (A6), one row."""
    return lists.agg(F.count("*").alias("n_lists")).crossJoin(pages.agg(F.count("*").alias("n_pages")))  # one row each


def without_excluded(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose URL starts with none of the excluded prefixes; null URLs stay."""
    from palimpsest.functions.predicates import starts_with_any

    return rows.where(~F.coalesce(starts_with_any(F.col("url"), prefixes), F.lit(False)))


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows as the JSON objects of an API response (SK11); null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def text_index(pages: DataFrame) -> DataFrame:
    """(url, title, ts_ms, text) of all pages that carry text, as a search index is filled (SC28)."""
    return pages.where("text is not null and text <> ''").select("url", "title", "ts_ms", "text")
