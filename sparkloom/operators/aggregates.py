"""Aggregations from regions to files, and the ratings that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import metrics
from sparkloom.functions.decision import effort_band, file_threshold, region_threshold
from sparkloom.functions.numeric import half_up, whole


def region_metrics(regions: DataFrame, text: str, kind: Column, smells: Column) -> DataFrame:
    """regions with line counts, complexities, maintainability, bundle weight and debt of their text."""
    t = F.col(text)
    stats = metrics.line_stats(t)
    out = regions.withColumns({**stats, "cc": metrics.cyclomatic(t), "loose_cc": metrics.loose_cyclomatic(t)})
    out = out.withColumn("mi", metrics.maintainability(t, F.col("loc"), F.col("cc")))
    out = out.withColumn("bundle", metrics.bundle_weight(kind, F.col("code_lines")))
    return out.withColumn("debt", metrics.debt_minutes(F.col("cc"), F.col("mi"), F.col("loc"), smells))


def file_metrics(regions: DataFrame, file: str) -> DataFrame:
    """One row a file: averages, maxima and sums of its regions' metrics, with a grade.

    One partial and one final aggregation; only the metric columns are shuffled.
    """
    avg1 = lambda c: half_up(F.avg(c), 1)
    out = regions.groupBy(file).agg(
        F.count("*").alias("regions"),
        F.sum("loc").alias("total_lines"),
        F.sum("code_lines").alias("code_lines"),
        F.sum("blank_lines").alias("blank_lines"),
        F.sum("comment_lines").alias("comment_lines"),
        avg1("cc").alias("avg_cc"),
        F.max("cc").alias("max_cc"),
        whole(F.avg("mi")).alias("avg_mi"),
        half_up(F.sum("bundle"), 1).alias("bundle"),
        F.sum("debt").alias("debt"),
    )
    return out.withColumn("grade", metrics.health_grade(F.col("avg_mi"), F.col("avg_cc")))


def repeated_words(df: DataFrame, file: str, text: str, regex: str, more_than: int = 5, scale: float = 30.0) -> DataFrame:
    """(file, frequent, risk): words that occur more often than so, and their number over ``scale``, 1 at most.

    Counts are aggregated by (file, word) before the shuffle; a file's words never meet in one list.
    """
    words = df.select(file, F.explode(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0))).alias("word"))
    frequent = words.groupBy(file, "word").agg(F.count("*").alias("n")).groupBy(file).agg(F.count_if(F.col("n") > more_than).alias("frequent"))
    files = df.select(file).distinct()
    joined = files.join(frequent, file, "left").withColumn("frequent", F.coalesce("frequent", F.lit(0)))
    return joined.withColumn("risk", half_up(F.least(F.lit(1.0), F.col("frequent") / scale), 2))


def token_counts(df: DataFrame, key: str, text: str, operators: str, operands: str) -> DataFrame:
    """(key, n1, n2, t1, t2): distinct and total matches of the two kinds of token, row by row."""
    found = lambda regex: F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0))
    out = df.select(key, found(operators).alias("o"), found(operands).alias("p"))
    return out.select(
        key,
        F.size(F.array_distinct("o")).alias("n1"),
        F.size(F.array_distinct("p")).alias("n2"),
        F.size("o").alias("t1"),
        F.size("p").alias("t2"),
    )


def calibrated_thresholds(regions: DataFrame, file: str, effort: str, setting: float = 0.35) -> DataFrame:
    """(file, p75, median, threshold, band): exact interpolated percentiles of the positive efforts of each file."""
    positive = F.when(F.col(effort) > 0, F.col(effort))
    out = regions.groupBy(file).agg(F.percentile(positive, 0.75).alias("p75"), F.percentile(positive, 0.5).alias("median"))
    return out.withColumn("threshold", file_threshold(F.col("p75"), setting)).withColumn("band", effort_band(F.coalesce("p75", F.lit(0.0))))


def region_thresholds(regions: DataFrame, file: str, effort: str, setting: float = 0.35) -> DataFrame:
    """regions with their file's median and threshold and their own threshold.

    The percentiles, one row a file, are joined back: a file of very many regions is split by AQE
    instead of filling one window.
    """
    files = calibrated_thresholds(regions, file, effort, setting).select(F.col(file).alias("__file"), "median", "threshold")
    out = regions.join(files, F.col(file).eqNullSafe(F.col("__file"))).drop("__file")
    return out.withColumn("region_threshold", region_threshold(F.col("threshold"), F.col(effort), F.col("median")))


def complexity_band(regions: Column, candidates: Column) -> Column:
    return (
        F.when((regions > 10) & (candidates > 5), "highly-complex")
        .when((regions > 6) & (candidates > 3), "complex")
        .when((regions > 3) & (candidates > 1), "moderate")
        .otherwise("simple")
    )
