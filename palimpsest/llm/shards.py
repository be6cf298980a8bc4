"""Operator 10, sharding: weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import durable

#: Hex digits of the hash that are compared: 52 bits, exact in a double.
DIGITS = 13
#: Rows of one shard are numbered in this many independent runs (three hex digits).
RUNS = 4096
#: One task expands at most so many equal rows at once.
BLOCK = 65_536


def _draw(key: Column, shard: int) -> Column:
    return F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, DIGITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the best draw for ``key``; of equal draws the lowest shard.

    Every shard draws from the key and its own number alone, so a further shard
    can only win rows for itself and a removed one gives up only its own rows.
    With weight w the score is -w / ln(u), u the draw in (0, 1).
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if len(set(weights)) == 1:  # the same order without floating point
        scored = [F.struct(_draw(key, s).alias("d"), F.lit(-s).alias("s")) for s in range(len(weights))]
    else:
        scored = [
            F.struct(
                (F.lit(-w) / F.log((F.conv(_draw(key, s), 16, 10).cast("double") + 0.5) / float(1 << 4 * DIGITS))).alias("d"),
                F.lit(-s).alias("s"),
            )
            for s, w in enumerate(weights)
        ]
    return -F.array_max(F.array(*scored))["s"]


def shard_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth for each row of ``docs``.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot,
    grown_shard (with one more shard of the mean weight). Null keys hash as the
    empty string; a null text has no bytes and crc32 0; repeated rows get slots
    of their own; columns besides ``key`` and ``text`` are not read. Empty
    tables give empty results.

    The text is read once and never shuffled. Rows are counted by (shard, run)
    first; a run is numbered alone and shifted by the rows of earlier runs, a
    table of at most shards x RUNS rows. Equal rows travel as one with a count.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        k.alias("_k"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "_k").agg(F.count("*").alias("_n"))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "_n",
        rendezvous(F.col("_k"), weights).alias("shard"),
        rendezvous(F.col("_k"), grown).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat(F.col("_k"), F.lit(":"), F.col("text_crc32").cast("string"))), 1, 3), 16, 10).cast("int").alias("_run"),
    )
    rows = durable(rows)
    by_run = rows.groupBy("shard", "_run").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_run.select("shard", "_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_run").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    # at most len(weights) * RUNS rows of three numbers, whatever the input
    joined = placed.join(F.broadcast(offsets) if len(weights) * RUNS <= 1 << 20 else offsets, ["shard", "_run"])
    one = joined.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK).cast("long"))).alias("_block")
    )
    last = F.least(F.col("_n"), (F.col("_block") + 1) * BLOCK) - 1
    every = one.select("*", F.explode(F.sequence(F.col("_block") * BLOCK, last)).alias("_copy"))
    return every.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_from") + F.col("_at") + F.col("_copy")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def manifest(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each shard, the balance report of a placement."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def expected_moves(n: int) -> float:
    """Share of rows that one more shard of equal weight takes, in expectation."""
    return 1 / (n + 1) if n > 0 else math.nan
