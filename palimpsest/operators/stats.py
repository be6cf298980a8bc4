"""Access statistics, verification summaries, counts and catalog sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def client_stats(hits: DataFrame, client: str = "client", ts: str = "ts_ms") -> DataFrame:
    """Count, first and last access of each client."""
    return hits.groupBy(client).agg(F.count("*").alias("n"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))


def with_parents(stats: DataFrame, clients: DataFrame) -> DataFrame:
    """Clients with the client whose page they were opened from."""
    parent = clients.select(F.col("client").alias("parent"), F.col("page_url").alias("_page"))
    parent = parent.groupBy("_page").agg(F.min("parent").alias("parent"))
    own = stats.join(clients.select("client", "referrer"), "client", "left")
    return own.join(parent, (own["referrer"] == parent["_page"]) & (own["client"] != parent["parent"]), "left").drop("_page")


def roll_up(stats: DataFrame) -> DataFrame:
    """Children's numbers added to their parents, one level."""
    top = stats.withColumn("root", F.coalesce("parent", "client"))
    return top.groupBy("root").agg(
        F.sum("n").cast("long").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        F.sum(F.when(F.col("parent").isNotNull(), 1).otherwise(0)).cast("long").alias("children"),
    )


def repeat_counter(requests: DataFrame, client: str, url: str, ts: str, counted: Column) -> DataFrame:
    """How often the client asked for the URL before, for requests that are counted (ST2)."""
    w = Window.partitionBy(client, url).orderBy(ts)
    return requests.where(counted).withColumn("skip", F.row_number().over(w) - 1)


def verification_summary(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Valid, invalid and unchecked rows (A5)."""
    own = rows.where(F.col("id").startswith(prefix)) if prefix else rows
    return own.agg(
        F.count_if(F.col("matched")).alias("n_valid"), F.count_if(~F.col("matched")).alias("n_invalid"), F.count_if(F.col("matched").isNull()).alias("n_unchecked")
    )


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, expected, matched): null where nothing was read yet (SK9, V3)."""
    got = actual.groupBy("id").agg(F.max("actual").alias("actual"))
    return expected.join(got, "id", "left").select("id", "expected", (F.col("expected") == F.col("actual")).alias("matched"))


def referrer_top(requests: DataFrame, levels: int = 4) -> DataFrame:
    """Requests with the page at the top of their referrer chain (ST5), by bounded self-joins."""
    up = requests.groupBy("url").agg(F.min("referrer").alias("_up"))
    out = requests.withColumn("top", F.coalesce("referrer", "url"))
    for _ in range(levels):
        step = up.select(F.col("url").alias("_at"), "_up")
        out = out.join(step, out["top"] == step["_at"], "left").withColumn("top", F.coalesce("_up", "top")).drop("_at", "_up")
    return out


def property_pivot(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row with a column of each named verification property: its expected value (A5)."""
    return rows.agg(*(F.max(F.when(F.col("id") == n, F.col("expected"))).alias(n) for n in names))
