"""Streaming forms: client statistics with watermarks, repeat counts, incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def client_windows(hits: DataFrame, client: str = "client", ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count, first and last access of each client and window (ST1).

    A client that vanishes leaves no event behind; its state ends with the watermark.
    """
    w = F.window(ts, width)
    return (
        hits.withWatermark(ts, late).groupBy(w, client)
        .agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
        .select(F.col("window.start").alias("start"), client, "n", "first", "last")
    )


#: State of a client and URL ends when the watermark is this far beyond its last request.
FORGET_MS = 86_400_000


def _repeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    seen, newest = state.get[0] if state.exists else 0, 0
    for b in batches:
        b = b.sort_values("ts", kind="stable")
        yield pd.DataFrame({"client": key[0], "url": key[1], "ts": b["ts"].to_numpy(), "skip": range(seen, seen + len(b))})
        seen += len(b)
        newest = max(newest, int(b["ts"].max().timestamp() * 1000))
    state.update((seen,))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + FORGET_MS)


def repeat_counts(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests (client, url, ts) with how often each was made before (ST2); state ends after a day unasked."""
    return requests.withWatermark("ts", late).groupBy("client", "url").applyInPandasWithState(
        _repeats, "client string, url string, ts timestamp, skip long", "seen long", "append", GroupStateTimeout.EventTimeTimeout
    )


def ingest(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, files_per_batch: int = 1000):  # noqa: ANN001, ANN201
    """Captures of new files in ``folder``, deduplicated a batch at a time, appended to ``target`` (ST4).

    A batch that is run again replaces its own part; captures repeated in later
    batches are settled when the store is read, by ``ingested``.
    """
    from palimpsest.operators.store import priority_dedup

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        priority_dedup(batch.where("ts_ms is not null")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The store that ``ingest`` filled: one capture for each (url, ts_ms) over all batches (SK3).

    Of one class the greatest ``seq`` is taken; a revisit yields to whatever batch holds its original.
    """
    from palimpsest.operators.store import priority_dedup

    return priority_dedup(spark.read.option("basePath", target).parquet(target).drop("batch"))
