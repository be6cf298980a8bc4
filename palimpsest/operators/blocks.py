"""Sparse index blocks and archive pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.urls import surt
from palimpsest.operators.lookup import carry
from palimpsest.session import durable

MAX_BLOCKS = 7
LAST = "\U0010ffff"
_BEFORE = -(1 << 60)  # before any time


def running(rows: DataFrame, key: str, order: list[str], counted: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``counted`` over the rows of the key up to this one in ``order``.

    Rows are range-partitioned by key and order and counted within partitions;
    what earlier partitions hold of the key comes from one row a partition, so
    a key with a third of all rows is counted by many tasks.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written before use: the ranges are sampled once, and both readers see the same parts
    parts = durable(rows.withColumn("_one", counted.cast("long")).repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()))
    total = parts.groupBy(key, "_part").agg(F.sum("_one").alias("_n"))
    along = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows of a key
    before = total.select(key, "_part", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_local", F.sum("_one").over(here)).join(before, [key, "_part"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_one", "_part", "_local", "_before")


def candidate_blocks(blocks: DataFrame, requests: DataFrame, key: Column | None = None, as_prefix: bool = False) -> DataFrame:
    """(request, block) for blocks whose keys may hold the request's.

    A block holds the keys from its prefix up to the next block's. Keys of a
    request run from its match key to its upper key. The different keys and the
    blocks of an archive are put in order and each key's range of block numbers
    is read off running counts: no pair that does not match is ever built, and
    a key that many requests share is counted once.
    """
    req = _ranges(requests, key, as_prefix)
    return req.join(_held(blocks, req), _GROUP).drop("_low", "_high")


_GROUP = ["archive", "_low", "_high"]


def _ranges(requests: DataFrame, key: Column | None, as_prefix: bool) -> DataFrame:
    """``requests`` with the first (``_low``) and last (``_high``) of their keys."""
    k = surt(F.col("url")) if key is None else key
    low = k if not as_prefix else F.substring_index(k, "?", 1)
    high = F.concat(k, F.lit(" 9999")) if not as_prefix else F.concat(low, F.lit(LAST))
    return requests.select("*", low.alias("_low"), high.alias("_high"))


def _held(blocks: DataFrame, req: DataFrame) -> DataFrame:
    """The blocks of every different range of keys."""
    keys = req.select(*_GROUP).distinct()
    marks = blocks.select("archive", F.col("prefix").alias("_at"), F.lit(0).alias("_kind"), F.lit("").alias("_low"), F.lit("").alias("_high"))
    for kind, c in ((1, "_low"), (2, "_high")):
        marks = marks.unionByName(keys.select("archive", F.col(c).alias("_at"), F.lit(kind).alias("_kind"), "_low", "_high"))
    counted = durable(running(marks, "archive", ["_at", "_kind"], F.col("_kind") == 0, "_n"))
    numbered = counted.where("_kind = 0").select("archive", F.col("_at").alias("prefix"), F.col("_n").alias("_nth"))
    # the last block at or before the low key may hold it; a block that starts there keeps its forerunner too
    span = counted.where("_kind > 0").groupBy(*_GROUP).agg(F.max(F.when(F.col("_kind") == 1, F.col("_n"))).alias("_lo"), F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias("_hi"))
    wanted = span.where("_hi >= greatest(_lo, 1)").select(*_GROUP, F.explode(F.sequence(F.greatest("_lo", F.lit(1)), F.col("_hi"))).alias("_nth"))
    return wanted.join(numbered, ["archive", "_nth"]).drop("_nth").join(blocks, ["archive", "prefix"])


def nearest_blocks(found: DataFrame, block_ts: Column, limit: int = MAX_BLOCKS) -> DataFrame:
    """Of a request's blocks the nearest in time, at most ``limit``."""
    w = Window.partitionBy("req_id").orderBy(F.abs(block_ts - F.col("ts_ms")), "archive", "prefix")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def nearest_candidates(blocks: DataFrame, requests: DataFrame, block_ts: Column, key: Column | None = None, as_prefix: bool = False, limit: int = MAX_BLOCKS) -> DataFrame:
    """What nearest_blocks() leaves of candidate_blocks(), without its pairs.

    Of each range of keys the first ``limit`` blocks of a time are kept, each time is told the blocks
    of the ``limit`` times before it and of as many from it on, and a request takes the list of the time
    that an as-of lookup finds for it. Pairs are built of blocks and different ranges only.
    """
    req = _ranges(requests, key, as_prefix)
    held = _held(blocks, req).withColumn("_bt", block_ts)
    first = lambda rows, by: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("prefix"))).where(F.col("_n") <= limit)
    block = F.struct("_bt", *[c for c in blocks.columns if c != "archive"])
    times = first(held, [*_GROUP, "_bt"]).groupBy(*_GROUP, "_bt").agg(F.collect_list(block).alias("_b"))
    about = Window.partitionBy(*_GROUP).orderBy("_bt")
    # blocks without a time come first, whatever the request's
    untimed = F.first(F.when(F.col("_bt").isNull(), F.col("_b"))).over(about.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    close = F.flatten(F.collect_list(F.when(F.col("_bt").isNotNull(), F.col("_b"))).over(about.rowsBetween(-limit, limit - 1)))
    near = times.select(F.struct(*_GROUP).alias("_g"), F.coalesce("_bt", F.lit(_BEFORE)).cast("long").alias("_t"), F.when(untimed.isNull(), close).otherwise(F.concat(untimed, close)).alias("_near"))
    asked = req.where("ts_ms is not null").select(F.struct(*_GROUP).alias("_g"), F.col("ts_ms").cast("long").alias("_t"), F.struct(*req.columns).alias("_req"))
    rows = asked.withColumn("_p", F.lit(None).cast("struct<t: bigint>")).unionByName(near.select("_g", "_t", F.struct(F.col("_t").alias("t")).alias("_p")), allowMissingColumns=True)
    rows = carry(carry(rows, "_g", "_t", "_p", "_next", forward=True), "_g", "_t", "_p", "_last").where("_req is not null")
    timed = rows.select("_g", F.coalesce("_next.t", "_last.t").alias("_t"), "_req").join(near, ["_g", "_t"]).select("_req.*", "_near")
    top = first(held, _GROUP).groupBy(*_GROUP).agg(F.collect_list(block).alias("_near"))
    found = timed.unionByName(req.where("ts_ms is null").join(top, _GROUP).select(*req.columns, "_near"))
    ranked = F.array_sort(F.transform("_near", lambda b, i: F.struct(F.abs(b["_bt"] - F.col("ts_ms")).alias("d"), b["prefix"].alias("p"), i.alias("i"))))
    # array_sort puts nulls of a struct's fields first, as the window's order does
    best = F.transform(F.slice(ranked, 1, limit), lambda x: F.get("_near", x["i"]))
    pairs = found.select(*requests.columns, F.explode(best).alias("_b")).select(*requests.columns, "_b.*")
    return nearest_blocks(pairs, F.col("_bt"), limit).drop("_bt")


def archives_for(requests: DataFrame, pages: DataFrame, cap: int = 3) -> DataFrame:
    """Archives to search for a request: those with a page of its URL, with or without www.."""
    bare = lambda c: F.regexp_replace(c, r"^(https?://)www\.", "$1")
    known = pages.select(bare(F.col("url")).alias("_u"), "archive").distinct()
    hit = requests.withColumn("_u", bare(F.col("url"))).join(known, "_u").drop("_u")
    w = Window.partitionBy("req_id").orderBy("archive")
    return hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def first_archive(primary: DataFrame, fallback: DataFrame, req_id: str = "req_id") -> DataFrame:
    """Hits of the own archive, else of those it depends on."""
    other = fallback.select(req_id, F.col("hit").alias("_other"))
    return primary.join(other, req_id, "left").withColumn("hit", F.coalesce("hit", "_other")).drop("_other")


def blocks_to_load(found: DataFrame) -> DataFrame:
    """Blocks that any request needs and nobody loaded yet, each once."""
    return found.where("not coalesce(loaded, false)").groupBy("archive", "prefix").agg(F.count("*").alias("asked"))


def archives_to_try(requests: DataFrame, pages: DataFrame, archives: DataFrame, cap: int = 3) -> DataFrame:
    """(req_id, archive) in the order of L17: archives with a page of the URL, then one without its
    leading www., then seed archives of the request's crawl, else any; the first kind that has any, ``cap`` at most.

    Archives by crawl and all archives are cut to ``cap`` before they meet requests.
    """
    bare = lambda c: F.regexp_replace(c, r"^(https?://)www\.", "$1")
    known = pages.select(F.col("url").alias("_u"), "archive").distinct()
    exact = requests.join(known, requests["url"] == known["_u"]).select("req_id", "archive", F.lit(0).alias("kind"))
    www = requests.where(bare(F.col("url")) != F.col("url")).select("req_id", bare(F.col("url")).alias("_u"))
    near = www.join(known, "_u").select("req_id", "archive", F.lit(1).alias("kind"))
    first = lambda rows, by: rows.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("name")), 1, cap).alias("_names"))
    seeds = first(archives.where("has_seed"), ["crawl_id"])
    crawl = requests.where("crawl_id is not null").join(seeds, "crawl_id").select("req_id", F.explode("_names").alias("archive"), F.lit(2).alias("kind"))
    every = requests.crossJoin(F.broadcast(first(archives, []))).select("req_id", F.explode("_names").alias("archive"), F.lit(3).alias("kind"))  # one row of names
    tried = exact.unionByName(near).unionByName(crawl).unionByName(every)
    best = tried.groupBy("req_id").agg(F.min("kind").alias("kind"))
    w = Window.partitionBy("req_id").orderBy("archive")
    return tried.join(best, ["req_id", "kind"]).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def search_archives(first: DataFrame, others: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of the archives that are loaded; of queries that found nothing there, those of all others."""
    answered = first.select(key).distinct()
    return first.unionByName(others.join(answered, key, "left_anti"))
