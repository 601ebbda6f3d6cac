"""The documents on their way to a training corpus: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, shared_folder, table
from sparkloom.llm.mixing import copies, fit_domains, mix
from sparkloom.llm.near_dups import keep_representatives
from sparkloom.llm.sharding import with_shards
from sparkloom.llm.toxicity import fit_toxicity, score_toxicity
from sparkloom.llm.winnowing import find_contamination

SHARDS = 40
# Shares of the domains in the mixture, of the tokens that come in.
MIXTURE = {"good": 0.85, "poor": 0.14, "good_toxic": 0.008, "poor_toxic": 0.002}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.5 or more, whatever their labels say."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_toxicity(docs, model).where("__toxicity < 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_representatives(docs, "doc_id", "text", shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words (or all words, if fewer) of a benchmark item."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("__items") == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, from not at all to five times: what there is too much of is taken less often."""
    model = fit_domains(docs, table(spark, sf_dir, "labels"), F.lit(True))
    rows = mix(docs, model, MIXTURE).rows
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies(F.col("__rate"), F.col("doc_id"))))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard of each document, and the one that it would have if there were one more."""
    return with_shards(docs, ["doc_id"], SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No stage but the last can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to the shared folder and read again, and deleted once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            done = spark._jvm.org.apache.hadoop.fs.Path(before)
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
        before = path
    return docs
