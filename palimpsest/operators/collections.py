"""The catalog of collections: list, create, update, delete, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = ("live", "remoteproxy")


def listed(collections: DataFrame, type_prefix: str = "") -> DataFrame:
    """Collections shown to readers."""
    own = collections.where(~F.col("type").isin(*HIDDEN))
    return own.where(F.col("type").startswith(type_prefix)) if type_prefix else own


def create(collections: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog with new collections; names already there win (SK10)."""
    return collections.unionByName(new.join(collections, "name", "left_anti"), allowMissingColumns=True)


def delete(collections: DataFrame, names: list[str]) -> DataFrame:
    return collections.where(~F.col("name").isin(*names)) if names else collections


def merge_metadata(collections: DataFrame, name: str, metadata: dict[str, str]) -> DataFrame:
    """Metadata of one collection with new values over old ones."""
    extra = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv])
    kept = F.map_filter(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")), lambda k, _: ~k.isin(*metadata))
    return collections.withColumn("metadata", F.when(F.col("name") == name, F.map_concat(kept, extra)).otherwise(F.col("metadata")))


def update_auth(collections: DataFrame, name: str, headers: dict[str, str]) -> DataFrame:
    new = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    return collections.withColumn("headers", F.when(F.col("name") == name, new).otherwise(F.col("headers")))


def add_sizes(collections: DataFrame, growth: DataFrame) -> DataFrame:
    """Sizes with (name, full, dedup) rows added."""
    more = growth.groupBy("name").agg(F.sum("full").cast("long").alias("_f"), F.sum("dedup").cast("long").alias("_d"))
    out = collections.join(more, "name", "left")
    return out.withColumns({
        "total_size": F.coalesce("total_size", F.lit(0)) + F.coalesce("_f", F.lit(0)),
        "size": F.coalesce("size", F.lit(0)) + F.coalesce("_d", F.lit(0)),
    }).drop("_f", "_d")


def archive_groups(archives: DataFrame) -> DataFrame:
    """Archives that hold seed pages, by crawl."""
    return archives.where("has_seed").groupBy("crawl_id").agg(F.array_sort(F.collect_set("name")).alias("archives"))
