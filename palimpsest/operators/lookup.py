"""As-of lookups of captures: which capture of a URL was current at a time?

All forms are running windows over requests and captures in one table, by URL:
rows are shuffled once for all windows of a lookup. A URL that holds much of
the table is cut into (URL, time bucket): a bucket is scanned alone, and what
earlier buckets carry over comes from a summary with one row a bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.urls import join_url

#: Width of a time bucket: one day.
BUCKET_MS = 86_400_000
#: Keys with more rows are cut into buckets; they are told by their hash, so that counting them takes SLOTS rows a task.
HOT_ROWS, SLOTS = 200_000, 1 << 16
LOOK_AHEAD_MS = 10_000
FORWARD_ROWS = 16
MAX_MS = 253_370_764_800_000  # beyond any capture; stands for "no time given"


def skip_capture(skip5xx: bool = False, c: str = "") -> Column:
    """Captures that a lookup passes over: redirects to themselves and, on demand, 5xx.

    A redirect without a Location counts as one to itself; relative Locations
    are resolved first.
    """
    col = lambda n: F.col(f"{c}.{n}" if c else n)
    status, url, to = col("status"), col("url"), F.coalesce(col("location"), F.lit(""))
    loop = (status >= 300) & (status < 400) & ((to == "") | (join_url(url, to) == url))
    return F.coalesce(loop | (status >= 500) if skip5xx else loop, F.lit(False))


def by_heat(rows: DataFrame, key: str, run: Callable[[DataFrame, int | None], DataFrame], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``run`` of the rows of common keys, shuffled by key, and of those of hot keys, to be cut into
    buckets. Counts rows at once; of many hot slots the thousand largest, others hold less than a thousandth of all rows."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    counts = rows.groupBy(slot.alias("_slot")).count().where(F.col("count") > HOT_ROWS)
    hot = [x["_slot"] for x in counts.orderBy(F.desc("count")).limit(1000).collect()]
    if not hot:
        return run(rows.repartition(key), None)
    return run(rows.where(~slot.isin(hot)).repartition(key), None).unionByName(run(rows.where(slot.isin(hot)), bucket_ms))


def carry(rows: DataFrame, key: str, t: str, payload: str, out: str, forward: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``rows`` with ``out``: the last non-null ``payload`` of the key at or before ``t``
    (first at or after it, ``forward``). Rows with a payload come first at equal times;
    of these the one with the greatest payload (least, forward) is taken."""
    return by_heat(rows, key, lambda part, width: _carry(part, key, t, payload, out, forward, width), bucket_ms)


def _carry(rows: DataFrame, key: str, t: str, payload: str, out: str, forward: bool = False, bucket_ms: int | None = None) -> DataFrame:
    """carry() of rows of common keys, or with ``bucket_ms`` cut into buckets."""
    b = "_bucket"
    has = F.col(payload).isNotNull()
    order = [F.desc(t), F.desc(has), F.desc(payload)] if forward else [F.asc(t), F.desc(has), F.asc(payload)]
    over = lambda *by: F.last(payload, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if bucket_ms is None:
        return rows.withColumn(out, over(key))
    rows = rows.withColumn(b, F.floor(F.col(t) / bucket_ms).cast("long"))
    pick = F.min if forward else F.max
    summary = rows.groupBy(key, b).agg(pick(F.when(has, F.struct(F.col(t).alias("t"), F.col(payload).alias("p")))).alias("_s"))
    along = Window.partitionBy(key).orderBy(F.desc(b) if forward else F.asc(b)).rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(key, b, F.last("_s", ignorenulls=True).over(along)["p"].alias("_before"))
    joined = rows.withColumn("_local", over(key, b)).join(before, [key, b], "left")
    return joined.withColumn(out, F.coalesce("_local", "_before")).drop("_local", "_before", b)


def _ordinals(rows: DataFrame, key: str, t: str, counted: Column, out: str, bucket_ms: int | None = None) -> DataFrame:
    """``rows`` with ``out``: how many counted rows of the key lie before ``t`` (0 for the first)."""
    b = "_bucket"
    rows = rows.withColumn("_one", counted.cast("long"))
    here = lambda *by: F.coalesce(F.sum("_one").over(Window.partitionBy(*by).orderBy(F.asc(t)).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if bucket_ms is None:
        return rows.withColumn(out, here(key)).drop("_one")
    rows = rows.withColumn(b, F.floor(F.col(t) / bucket_ms).cast("long"))
    total = rows.groupBy(key, b).agg(F.sum("_one").alias("_n"))
    along = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(key, b, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    joined = rows.withColumn("_local", here(key, b)).join(before, [key, b])
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_one", b)


@dataclass(frozen=True)
class Options:
    """no_revisits and page_id select the filtered lookup, which tries 16 captures ahead."""

    skip5xx: bool = False
    no_revisits: bool = False
    page_id: object = None
    bucket_ms: int = BUCKET_MS

    @property
    def filtered(self) -> bool:
        return self.no_revisits or self.page_id is not None


def _capture_struct(captures: DataFrame, columns: list[str]) -> Column:
    return F.struct(F.col("ts_ms"), *[F.col(c) for c in columns if c not in ("ts_ms", "url")])


def union_rows(requests: DataFrame, captures: DataFrame, columns: list[str], dropped: Column, key: str = "url") -> DataFrame:
    """Requests (``_req`` not null) and captures (``_cap`` not null) by key and time ``_t``; captures without a key match nothing."""
    cap = captures.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col("ts_ms").alias("_t"), _capture_struct(captures, columns).alias("_cap"), dropped.alias("_drop"), F.lit(None).alias("_req")
    )
    req = requests.select(
        F.col(key).alias("_key"), F.coalesce(F.nullif("ts_ms", F.lit(0)), F.lit(MAX_MS)).alias("_t"), F.lit(None).alias("_cap"), F.lit(None).cast("boolean").alias("_drop"),
        F.struct(*requests.columns).alias("_req"),
    )
    return cap.unionByName(req)


def lookup(requests: DataFrame, captures: DataFrame, columns: list[str], options: Options = Options(), key: str = "url") -> DataFrame:
    """``requests`` (url, ts_ms and more) with ``hit``, a struct of the capture found or null.

    Without a time (null or 0) the newest capture counts. Otherwise it is the
    first at or after the time; if that one is skipped, the newest not later
    than ten seconds after the time; if there is none, the newest before. The
    filtered form drops captures of other pages (null pages pass), revisits and
    skipped ones, trying at most FORWARD_ROWS captures ahead, then backwards.
    """
    skipped = skip_capture(options.skip5xx)
    drop = skipped
    if options.no_revisits:
        drop = drop | F.coalesce(F.col("mime") == "warc/revisit", F.lit(False))
    if options.page_id is not None:
        drop = drop | F.coalesce(F.col("page_id") != options.page_id, F.lit(False))
    rows = union_rows(requests, captures, columns, drop, key)
    return by_heat(rows, "_key", lambda part, width: _looked_up(part, options, width), options.bucket_ms)


def _looked_up(rows: DataFrame, options: Options, width: int | None) -> DataFrame:
    """lookup() of united rows, by whole keys or in buckets."""
    rows = rows.withColumn("_alive", F.when(~F.col("_drop"), F.col("_cap")))
    if options.filtered:
        rows = _ordinals(rows, "_key", "_t", F.col("_cap").isNotNull(), "_nth", width)
        rows = rows.withColumn("_ahead", F.when(F.col("_alive").isNotNull(), F.struct(F.col("_t").alias("t"), "_alive", "_nth")))
        rows = _carry(rows, "_key", "_t", "_ahead", "_next", forward=True, bucket_ms=width)
        ok = (F.col("_t") < MAX_MS) & (F.col("_next._nth") - F.col("_nth") < FORWARD_ROWS)
        rows = rows.withColumn("_fwd", F.when(ok, F.col("_next._alive"))).withColumn("_probe", F.col("_t"))
    else:
        rows = rows.withColumn("_any", F.when(F.col("_cap").isNotNull(), F.struct(F.col("_t").alias("t"), "_cap", "_drop")))
        rows = _carry(rows, "_key", "_t", "_any", "_next", forward=True, bucket_ms=width)
        timed = F.col("_t") < MAX_MS
        rows = rows.withColumn("_fwd", F.when(timed & ~F.col("_next._drop"), F.col("_next._cap")))
        late = F.when(F.col("_req").isNotNull() & timed & F.coalesce(F.col("_next._drop"), F.lit(False)), LOOK_AHEAD_MS).otherwise(0)
        rows = rows.withColumn("_probe", F.col("_t") + late)
    rows = _carry(rows.select("_key", "_probe", "_alive", "_fwd", "_req"), "_key", "_probe", "_alive", "_bwd", bucket_ms=width)
    found = rows.where(F.col("_req").isNotNull())
    return found.select("_req.*", F.coalesce("_fwd", "_bwd").alias("hit"))


def nearest(requests: DataFrame, captures: DataFrame, columns: list[str], key: str = "url", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``requests`` with ``hit``: the capture nearest in time; of two the earlier."""
    rows = union_rows(requests, captures, columns, F.lit(False), key)

    def run(part: DataFrame, width: int | None) -> DataFrame:
        part = _carry(part, "_key", "_t", "_cap", "_bwd", bucket_ms=width)
        part = _carry(part, "_key", "_t", "_cap", "_fwd", forward=True, bucket_ms=width)
        back, ahead = F.col("_t") - F.col("_bwd.ts_ms"), F.col("_fwd.ts_ms") - F.col("_t")
        hit = F.when(F.col("_fwd").isNull() | (back <= ahead), F.col("_bwd")).otherwise(F.col("_fwd"))
        return part.where(F.col("_req").isNotNull()).select("_req.*", hit.alias("hit"))

    return by_heat(rows, "_key", run, bucket_ms)


def latest(captures: DataFrame, columns: list[str], skip5xx: bool = False) -> DataFrame:
    """The newest capture of each URL that isn't skipped; one aggregate with map-side combination."""
    best = F.max_by(F.struct(*columns), F.struct("ts_ms"))
    return captures.where(~skip_capture(skip5xx)).groupBy("url").agg(F.max("ts_ms").alias("ts_ms"), best.alias("_c")).select("url", "ts_ms", "_c.*")


def resolve_revisits(captures: DataFrame, columns: list[str], depth: int = 2, options: Options = Options(no_revisits=True)) -> DataFrame:
    """Revisits with ``hit``, the original they stand for, looked up by (orig_url, orig_ts_ms).

    Up to ``depth`` rounds follow revisits that were found instead of originals;
    each round is one as-of join, no recursion.
    """
    revisit = captures.where("mime = 'warc/revisit'")
    probe = revisit.select("event_id", F.coalesce("orig_url", "url").alias("url"), F.coalesce("orig_ts_ms", "ts_ms").alias("ts_ms"))
    out = lookup(probe, captures, columns, options)
    for _ in range(depth - 1):
        again = out.where("hit is null").select("event_id", "url", "ts_ms")
        out = out.where("hit is not null").unionByName(lookup(again, captures.where("mime <> 'warc/revisit' or mime is null"), columns, Options()))
    return out


def scheme_candidates(url: Column) -> Column:
    """URLs to try for a request, in order."""
    return (
        F.when(url.startswith("//"), F.array(F.concat(F.lit("https:"), url), F.concat(F.lit("http:"), url)))
        .when(url.startswith("http://"), F.array(url, F.concat(F.lit("https://"), F.substring(url, 8, 1 << 20))))
        .otherwise(F.array(url))
    )


def with_scheme_fallback(requests: DataFrame, captures: DataFrame, columns: list[str], req_id: str, options: Options = Options()) -> DataFrame:
    """Lookup of every candidate scheme; the first that hits wins (L18 over L1)."""
    tries = requests.select("*", F.posexplode(scheme_candidates(F.col("url"))).alias("_rank", "_try"))
    found = lookup(tries.select(*[c for c in requests.columns if c != "url"], F.col("url").alias("asked"), "_rank", F.col("_try").alias("url")), captures, columns, options)
    # a try that found nothing is needed for the address asked only, and the address of a try is told by its rank
    kept = found.where((F.col("_rank") == 0) | F.col("hit").isNotNull()).select(req_id, F.when(F.col("_rank") == 0, F.col("asked")).alias("asked"), F.when(F.col("hit").isNotNull(), F.col("_rank")).alias("_rank"), "hit")
    best = kept.groupBy(req_id).agg(F.max("asked").alias("asked"), F.min_by(F.struct("_rank", "hit"), "_rank").alias("_b"))
    return best.select(req_id, "asked", F.get(scheme_candidates(F.col("asked")), F.col("_b._rank")).alias("url"), F.col("_b.hit").alias("hit"))


def follow_origin(found: DataFrame, captures: DataFrame, columns: list[str], req_id: str) -> DataFrame:
    """Hits that name an original are replaced by it where it is found."""
    moved = found.where("hit.orig_url is not null").select(req_id, F.col("hit.orig_url").alias("url"), F.coalesce("hit.orig_ts_ms", "ts_ms").alias("ts_ms"))
    better = lookup(moved, captures, columns).select(req_id, F.col("hit").alias("_better"))
    return found.join(better, req_id, "left").withColumn("hit", F.coalesce("_better", "hit")).drop("_better")


NULL_BODY = (101, 204, 205, 304)
EMPTY_DIGESTS = (
    "sha-256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ",
)


def with_payload(found: DataFrame, payloads: DataFrame, digest: str = "digest") -> DataFrame:
    """Rows with their payload by digest; known empty digests need no join, null-body statuses no payload."""
    joined = found.join(payloads.select(F.col("digest").alias("_d"), F.col("payload").alias("_p")), F.col(digest) == F.col("_d"), "left")
    body = F.when(F.col(digest).isin(*EMPTY_DIGESTS), F.lit(b"")).otherwise(F.coalesce("_p", "payload") if "payload" in found.columns else F.col("_p"))
    none = F.col("status").isin(*NULL_BODY)
    out = joined.withColumns({"payload": body, "complete": none | body.isNotNull()}).drop("_d", "_p")
    return out.where("complete").drop("complete")


def resolve(requests: DataFrame, captures: DataFrame, payloads: DataFrame, columns: list[str], options: Options = Options()) -> DataFrame:
    """The whole way of a request (L20): schemes in turn, as-of capture, else the most similar URL,
    the original of a redirect, and its payload.

    ``requests`` hold req_id, url and ts_ms. Returns req_id, asked, url (found under), fuzzy, the
    capture's columns and payload; requests without a complete capture are left out.
    """
    from palimpsest.operators.fuzzy import best_matches
    from palimpsest.session import durable

    plain = durable(with_scheme_fallback(requests, captures, columns, "req_id", options))
    missed = plain.where("hit is null").select("req_id", F.col("asked").alias("url"))
    like = best_matches(missed, captures).select("req_id", F.col("url").alias("asked"), F.col("hit_url").alias("url"))
    again = like.join(requests.select("req_id", "ts_ms"), "req_id")
    fuzzy = lookup(again, captures, columns, options).where("hit is not null").select("req_id", "asked", "url", "hit", F.lit(True).alias("fuzzy"))
    found = plain.where("hit is not null").select("req_id", "asked", "url", "hit", F.lit(False).alias("fuzzy")).unionByName(fuzzy)
    if "orig_url" in columns:
        found = follow_origin(found.join(requests.select("req_id", "ts_ms"), "req_id"), captures, columns, "req_id").drop("ts_ms")
    return with_payload(found.select("req_id", "asked", "url", "fuzzy", "hit.*"), payloads)


def nearest_page(requests: DataFrame, pages: DataFrame, columns: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``requests`` with ``hit``: the first page less than a second away, else the nearest."""
    close = union_rows(requests.withColumns({"_at": F.col("ts_ms"), "ts_ms": F.col("ts_ms") - 999}), pages, columns, F.lit(False))
    close = carry(close, "_key", "_t", "_cap", "_close", forward=True, bucket_ms=bucket_ms).where("_req is not null")
    within = F.col("_close.ts_ms") - F.col("_req._at") < 1000
    early = close.select("_req.*", F.when(within, F.col("_close")).alias("_early")).withColumn("ts_ms", F.col("_at")).drop("_at")
    return nearest(early, pages, columns, bucket_ms=bucket_ms).withColumn("hit", F.coalesce("_early", "hit")).drop("_early")
