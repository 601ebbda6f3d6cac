"""Reading tables, cutting lineage and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share.

    It is the one that ``spark.checkpoint.dir`` names; a temporary one is set only where the session
    has none (single-machine tests).
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="sparkloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(id_column: str, n: int):
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def splitmix(i: int) -> int:
    """The i-th value of a fixed pseudo-random sequence of unsigned 64-bit integers."""
    z = (i * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
    return z ^ (z >> 31)


def signed(x: int) -> int:
    """An unsigned 64-bit integer as the BIGINT with the same bits."""
    return x - 2**64 if x >= 2**63 else x
