"""Store operators: priority dedup, reference counts, cascades, page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import schema

REVISIT = "warc/revisit"


def capture_class(mime: Column, status: Column) -> Column:
    """0 success, 1 redirect or error, 2 revisit (A2)."""
    return F.when(mime == REVISIT, 2).when(F.coalesce(status, F.lit(200)) >= 300, 1).otherwise(0)


def priority_dedup(captures: DataFrame, seq: str = "seq") -> DataFrame:
    """One capture for each (url, ts_ms): best class, then the latest by ``seq``.

    An aggregate with map-side combination, so a key that is repeated often
    does not gather in one task.
    """
    rank = F.struct(-capture_class(F.col("mime"), F.col("status")), F.col(seq))
    rest = [c for c in captures.columns if c not in ("url", "ts_ms")]
    best = captures.groupBy("url", "ts_ms").agg(F.max_by(F.struct(*rest), rank).alias("_c"))
    return best.select("url", "ts_ms", "_c.*")


def without_seen_revisits(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows less revisits of (url, ts_ms) that a non-revisit holds already (SK2, J8)."""
    held = existing.where(f"mime is null or mime <> '{REVISIT}'").select("url", "ts_ms").distinct().withColumn("_revisit", F.lit(True))
    tagged = incoming.withColumn("_revisit", F.coalesce(F.col("mime") == REVISIT, F.lit(False)))
    return tagged.join(held, ["url", "ts_ms", "_revisit"], "left_anti").drop("_revisit")


def upsert(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Both tables as one, priority-deduplicated; incoming rows come later (SK1-SK3). Rows without a time are dropped."""
    fresh = incoming.where("ts_ms is not null")
    old = existing.withColumn("_gen", F.lit(0))
    both = old.unionByName(fresh.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return priority_dedup(both.withColumn("_order", F.struct("_gen", seq)), "_order").drop("_gen", "_order")


def payload_digest(payload: Column, min_size: int = 1024) -> Column:
    """SHA-256 name of a payload larger than ``min_size`` (A3); null otherwise."""
    return F.when(F.octet_length(payload) > min_size, F.concat(F.lit("sha-256:"), F.sha2(payload, 256)))


def digest_refs(captures: DataFrame, size: Column) -> DataFrame:
    """References and size of each digest (A1)."""
    return captures.where("digest is not null").groupBy("digest").agg(F.count("*").alias("refs"), F.max(size).cast("long").alias("size"))


def first_of_digest(captures: DataFrame, seq: str, digest: str = "digest") -> DataFrame:
    """``captures`` with is_new: whether the row is the first of its digest (A10).

    A join with the least ``seq`` of each digest, which is combined on the map
    side; rows without a digest are new and take no part, and a digest that a
    third of the rows share is split by adaptive execution.
    """
    known = captures.where(F.col(digest).isNotNull())
    first = known.groupBy(digest).agg(F.min(seq).alias("_first"))
    told = known.join(first, digest).withColumn("is_new", F.col(seq) == F.col("_first")).select(*captures.columns, "is_new")
    return told.unionByName(captures.where(F.col(digest).isNull()).withColumn("is_new", F.lit(True)))


def dedup_savings(captures: DataFrame, size: Column, digest: str = "digest") -> DataFrame:
    """Rows, digests and bytes with and without duplicates."""
    by = captures.groupBy(digest).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    return by.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_digests"),
        F.sum(F.col("n") * F.col("size")).cast("long").alias("bytes_all"), F.sum("size").cast("long").alias("bytes_once"),
    )


def delete_pages(captures: DataFrame, refs: DataFrame, page_ids: DataFrame, inline_size: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cascade of deleted pages (SK6, A4): captures left, references left, bytes freed.

    Freed are inline bodies of removed rows without a digest, and payloads
    whose references fall under one.
    """
    gone = captures.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    left = captures.join(page_ids.select("page_id").distinct(), "page_id", "left_anti")
    less = gone.where("digest is not null").groupBy("digest").agg(F.count("*").alias("_n"))
    now = refs.join(less, "digest", "left").withColumn("refs", F.col("refs") - F.coalesce("_n", F.lit(0)))
    freed = now.where("refs < 1 and _n is not null").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("freed"))
    if inline_size is not None:
        loose = gone.where("digest is null").agg(F.coalesce(F.sum(inline_size), F.lit(0)).cast("long").alias("loose"))
        freed = freed.crossJoin(loose).select((F.col("freed") + F.col("loose")).alias("freed"))  # one row each
    return left, now.where("refs > 0").drop("_n"), freed


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Pages with defaults (SK4): title, id, time and state; state 0 counts as none."""
    from palimpsest.functions.timestamps import page_ts

    have = set(pages.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    return pages.withColumns({
        "title": F.coalesce(col("title"), F.col("url")),
        "id": F.coalesce(col("id"), F.substring(F.sha2(F.concat_ws("|", F.col("url"), col("ts_ms", "long").cast("string")), 256), 1, 24)),
        "ts_ms": page_ts(col("ts_ms", "long"), col("timestamp"), F.coalesce(col("date"), col("datetime"))),
        "state": F.coalesce(F.nullif(col("state", "int"), F.lit(0)), F.lit(schema.SYNCED)),
    })


def curated_rows(lists: DataFrame, only_public: bool = True) -> DataFrame:
    """Rows of page lists: (list, pos, page) with positions from 0 (SK5)."""
    shown = lists.where(F.coalesce("show", F.lit(True))) if only_public and "show" in lists.columns else lists
    return shown.select(F.col("id").alias("list"), F.posexplode("pages").alias("pos", "page"))


def assemble_lists(lists: DataFrame, rows: DataFrame, item: list[str]) -> DataFrame:
    """Lists with their pages nested in order; joined by id."""
    nested = rows.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("pos", *item))).alias("pages"))
    return lists.join(nested, lists["id"] == nested["list"], "left").drop("list")


def fuzzy_twins(captures: DataFrame, canonical: Column) -> DataFrame:
    """Captures and, beside each that may stand for its canonical URL, a copy under that URL."""
    ok = F.col("status").between(200, 399) & ~F.col("status").isin(204, 304)
    twins = captures.withColumn("_canon", canonical).where(ok & (F.col("_canon") != F.col("url")))
    twins = twins.withColumns({"orig_url": F.col("url"), "orig_ts_ms": F.col("ts_ms"), "url": F.col("_canon")}).drop("_canon")
    base = captures
    for c, t in (("orig_url", "string"), ("orig_ts_ms", "long")):
        if c not in captures.columns:
            base = base.withColumn(c, F.lit(None).cast(t))
    return base.unionByName(twins)


def pair_adjacent(records: DataFrame, group: str, order: str, left: Column, right: Column) -> DataFrame:
    """Adjacent records of a group paired greedily, either kind first (SC2).

    A maximal run of records where each could pair with the next is cut from its
    start into twos; the last of an odd run stays alone. Kinds alternate in a
    run, so the run's parity decides without a state machine.
    """
    w = Window.partitionBy(group).orderBy(order)
    kind = F.when(left, 1).when(right, 2)
    tagged = records.withColumn("_k", kind).withColumn("_p", F.lag("_k").over(w))
    fresh = (F.col("_k").isNull() | F.col("_p").isNull() | (F.col("_k") == F.col("_p"))).cast("int")
    runs = tagged.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("_nth", F.row_number().over(Window.partitionBy(group, "_run").orderBy(order)) - 1).withColumn("pair", F.floor(F.col("_nth") / 2)).drop("_k", "_p", "_nth")


def commit_payloads(payloads: DataFrame, loaded: DataFrame) -> DataFrame:
    """Payload table with bodies loaded on demand; one row a digest, those already there stay (SK7)."""
    new = loaded.where("digest is not null and payload is not null").groupBy("digest").agg(F.min("payload").alias("payload"))
    return payloads.select("digest", "payload").unionByName(new.join(payloads.select("digest"), "digest", "left_anti"))


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table of a store emptied, schema kept (SK8)."""
    return {name: t.limit(0) for name, t in tables.items()}


def migrate_curated(curated: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of page lists with the page's own columns where its id is known, else what the row held."""
    known = pages.select(F.col("id").alias("page"), F.col("url").alias("_url"), F.col("title").alias("_title"), F.col("ts_ms").alias("_ts"))
    out = curated.join(known, "page", "left")
    return out.withColumns({"url": F.coalesce("_url", "url"), "title": F.coalesce("_title", "title"), "ts_ms": F.coalesce("_ts", "ts_ms")}).drop("_url", "_title", "_ts")


def pages_with_text(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages with the text of the record of their URL and time (J16); of several the greatest."""
    by = texts.groupBy("url", "ts_ms").agg(F.max("text").alias("text"))
    return pages.drop("text").join(by, ["url", "ts_ms"], "left")
