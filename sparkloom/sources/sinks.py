"""What leaves the engine: plans applied to files, diagnostics, labels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import html_escape


def preflight(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """planned with ``status``: paths that exist already are skipped."""
    there = existing.select(F.col("path").alias("__p")).distinct().withColumn("__is", F.lit(True))
    joined = planned.join(there, F.col("path") == F.col("__p"), "left")
    return joined.withColumn("status", F.when(F.col("__is"), "skipped").otherwise("created")).drop("__p", "__is")


def apply_plan(planned: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """Writes (path, content) of what does not exist yet below folder, and returns the status of each path.

    The rows go through a staging table that must not exist yet, so a run that failed leaves nothing
    half done in it; empty plans and plans of which all exist are errors.
    """
    status = preflight(planned, existing)
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    if not counts:
        raise ValueError("nothing to apply")
    if "created" not in counts:
        raise ValueError("all files exist")
    status.where("status = 'created'").select("path", "content").write.mode("errorifexists").parquet(folder)
    return status.select("path", "status")


def diagnostics(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """hits on the lines of the first region of ``affected``; those without a region go."""
    level = F.when(F.col("severity").isin("critical"), "Error").when(F.col("severity").isin("high", "medium"), "Warning").otherwise("Information")
    first = hits.where(F.size("affected") > 0).withColumn("__first", F.element_at("affected", 1)).withColumn("level", level)
    return first.join(regions, F.col("__first") == F.col("region")).drop("__first")


def label_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each of the columns: its name and its value as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.label", "p.value")


def status(grade: Column, mi: Column, circular: Column, critical: Column) -> tuple[Column, Column]:
    """Text and alert level: cycles are errors, critical hits and grades D and F warnings."""
    text = F.concat(grade, F.lit(" · MI "), mi.cast("string"))
    level = F.when(circular, "error").when(critical | grade.isin("D", "F"), "warning").otherwise("ok")
    return text, level


def html_table(df: DataFrame, most: int = 1000) -> str:
    """The first rows as an HTML table; a report is for reading, so its length is bounded."""
    rows = df.select([html_escape(F.col(c).cast("string")).alias(c) for c in df.columns]).limit(most).collect()
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
