"""Differences between a current state and a stored snapshot, and what a bounded store keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_MINUTES = 30
MOST_REGIONS = 500
MOST_FILES = 100


def cache_diff(current: DataFrame, snapshot: DataFrame, now: Column, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """current(file, name, hash) with ``cached``: the snapshot holds the same hash, read within the time to live."""
    s = snapshot.select(F.col("file").alias("sf"), F.col("name").alias("sn"), F.col("hash").alias("sh"), "last_read")
    joined = current.join(s, (F.col("file") == F.col("sf")) & (F.col("name") == F.col("sn")), "left")
    fresh = (F.col("hash") == F.col("sh")) & (F.unix_timestamp(now) - F.unix_timestamp("last_read") < ttl_minutes * 60)
    return joined.withColumn("cached", F.coalesce(fresh, F.lit(False))).drop("sf", "sn", "sh", "last_read")


def cache_stats(diff: DataFrame) -> DataFrame:
    """One row: cached and dirty regions and the share of hits."""
    hits = F.count_if("cached")
    return diff.agg(hits.alias("cached"), F.count_if(~F.col("cached")).alias("dirty"), F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0).alias("hit_rate"))


def graph_dirty(current_files: DataFrame, snapshot_files: DataFrame) -> DataFrame:
    """(file, graph_dirty): whether the whole file's hash differs from the stored one, or none is stored."""
    s = snapshot_files.select(F.col("file").alias("sf"), F.col("hash").alias("sh"))
    joined = current_files.join(s, F.col("file") == F.col("sf"), "left")
    return joined.select("file", F.coalesce(F.col("hash") != F.col("sh"), F.lit(True)).alias("graph_dirty"))


def evict(entries: DataFrame, file: str, at: str, most_regions: int = MOST_REGIONS, most_files: int = MOST_FILES, tie: str = "name") -> DataFrame:
    """Entries that stay: in the most recently read files, of each the most recently read regions."""
    files = entries.groupBy(F.col(file).alias("__f")).agg(F.max(at).alias("__last"))
    kept = files.orderBy(F.desc("__last"), F.asc("__f")).limit(most_files).select("__f")
    inside = entries.join(kept, F.col(file) == F.col("__f")).drop("__f")
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.desc(at), F.asc(tie)))
    return inside.withColumn("__rn", rank).where(F.col("__rn") <= most_regions).drop("__rn")


def changed_files(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action): scan new or changed paths, keep those of equal mtime, drop what is no longer listed."""
    s = stored.select(F.col("path").alias("sp"), F.col("mtime").alias("sm"))
    joined = listing.select("path", "mtime").join(s, F.col("path") == F.col("sp"), "full_outer")
    action = F.when(F.col("path").isNull(), "drop").when(F.col("mtime").eqNullSafe(F.col("sm")), "keep").otherwise("scan")
    return joined.select(F.coalesce("path", "sp").alias("path"), action.alias("action"))


def invalidate(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries without those of the given files."""
    return entries.join(files.select("file").distinct(), "file", "left_anti")


def store(entries: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Entries overwritten by updates of equal keys."""
    return entries.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)
