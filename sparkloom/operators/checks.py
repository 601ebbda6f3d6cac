"""Checks of files against what a workspace already has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.scans import has_event_handlers

DUPLICATE_RULE = "Duplicate Logic Detected"
CLIENT_RULE = "React Server Component uses client features"


def with_existing_tests(proposed: DataFrame, tests: DataFrame) -> DataFrame:
    """proposed(test_path, ...) with ``has_test``: some path of tests(path) ends with it.

    Every path stands for all its endings, whose number is bounded by its length, so this is a join
    by equality. A null test_path has no test; an empty one ends every path.
    """
    ends = tests.where(F.col("path").isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("path") + 1), lambda i: F.substring("path", i, F.length("path")))).alias("__end"))
    return proposed.join(ends.distinct().withColumn("has_test", F.lit(True)), F.col("test_path") == F.col("__end"), "left").drop("__end").withColumn("has_test", F.coalesce("has_test", F.lit(False)))


def client_features(regions: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name, severity, affected): files on the server side of a boundary whose regions use hooks or event handlers.

    regions(file, region, text, has_hooks), files(file, boundary, use_client). affected are the regions, sorted.
    """
    uses = regions.where(F.col("has_hooks") | has_event_handlers(F.col("text"))).select("file", "region")
    served = files.where(F.col("boundary") & ~F.col("use_client")).select(F.col("file").alias("__file"))
    found = uses.join(served, F.col("file") == F.col("__file")).groupBy("file").agg(F.array_sort(F.collect_set("region")).alias("affected"))
    return found.select("file", F.lit(CLIENT_RULE).alias("name"), F.lit("critical").alias("severity"), "affected")


def duplicate_logic(prints: DataFrame) -> DataFrame:
    """(file, name, severity, groups, affected): files of which several regions share a fingerprint.

    prints(file, region, fingerprint); rows with nulls and repeats don't count. groups is the number of
    shared fingerprints, affected the regions that have one, sorted.
    """
    seen = prints.select("file", "region", "fingerprint").dropna().distinct()
    shared = seen.groupBy("file", "fingerprint").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = seen.join(shared, ["file", "fingerprint"], "left_semi").groupBy("file").agg(F.countDistinct("fingerprint").alias("groups"), F.array_sort(F.collect_set("region")).alias("affected"))
    return found.select("file", F.lit(DUPLICATE_RULE).alias("name"), F.lit("high").alias("severity"), "groups", "affected")


def file_hits(duplicates: DataFrame, hits: DataFrame) -> DataFrame:
    """(file, name, severity, affected): the hits on whole files, and hits(file, region, name, severity) each with its region."""
    own = hits.select("file", "name", "severity", F.array("region").alias("affected"))
    return duplicates.select(own.columns).unionByName(own)


def store_stats(entries: DataFrame, now, hits, misses, evictions) -> DataFrame:
    """One row: entries and files of a store(file, last_read), the share of hits, and the mean age in seconds (0 if empty)."""
    age = F.avg(F.unix_timestamp(now) - F.unix_timestamp("last_read"))
    looked = hits + misses
    return entries.agg(
        F.count("*").alias("entries"), F.countDistinct("file").alias("files"), F.coalesce(age, F.lit(0.0)).alias("mean_age"),
        F.when(looked > 0, hits / looked).otherwise(0.0).alias("hit_rate"), hits.alias("hits"), misses.alias("misses"), evictions.alias("evictions"),
    )
