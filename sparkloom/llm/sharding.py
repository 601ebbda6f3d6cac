"""Shards by jump consistent hashing, without a table of ring positions; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import table

#: Jumps that are made before the rest of a longer walk is looked at.
SHORT_WALK = 16
#: So many slots of one repeated row are numbered at once.
RANGE = 10_000


def _jumps(key: list[Column], n: Column, state: Column, first: int, last: Column) -> Column:
    """Jumps number first to last: b is the shard so far, j the next shard, until j is n or more."""

    def jump(s: Column, i: Column) -> Column:
        # A fresh uniform number in (0, 1] for each key and jump. It doesn't depend on n.
        uniform = (F.shiftrightunsigned(F.xxhash64(*key, i), 11) + F.lit(1)) / F.lit(float(2**53))
        onward = F.struct(s.getField("j").alias("b"), F.floor((s.getField("j") + 1) / uniform).cast("bigint").alias("j"))
        return F.when(s.getField("j") >= n, s).otherwise(onward)

    return F.aggregate(F.sequence(F.lit(first), last), state, jump)


def jump_shard(key: list[Column], shards: int) -> Column:
    """STRUCT<b, j>: b is the shard of the key among ``shards``; j, at least ``shards``, the next shard it jumps to.

    With one more shard, the key moves to the new one if j equals ``shards`` and else stays. A walk
    has at most ``shards`` jumps and about ln(shards) on average: the first ``SHORT_WALK`` are always
    looked at, the rest only for keys that still walk.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    n = F.lit(shards).cast("bigint")
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    short = _jumps(key, n, start, 1, F.lit(min(shards, SHORT_WALK)))
    if shards <= SHORT_WALK:
        return short
    return F.when(short.getField("j") >= n, short).otherwise(_jumps(key, n, short, SHORT_WALK + 1, F.lit(shards)))


def with_shards(df: DataFrame, key_columns: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (the shard when there is one more) to every row.

    No shuffle. A null key part counts as a value of its own, so rows with equal keys stay together.
    Columns of df with these two names are replaced.
    """
    key = [F.col(c) for c in key_columns]
    if not key:
        raise ValueError("at least one key column")
    # The first element tells a null from any value; xxhash64 itself skips nulls.
    key = [x for c in key for x in (c.isNull(), c)]
    walked = jump_shard(key, shards)
    out = df.withColumn("__walk", walked)
    return (
        out.withColumn("shard", F.col("__walk.b").cast("int"))
        .withColumn("grown_shard", F.when(F.col("__walk.j") == shards, F.lit(shards)).otherwise(F.col("__walk.b")).cast("int"))
        .drop("__walk")
    )


def with_slots(rows: DataFrame, shard: str, key_columns: list[str], buckets: int = 256) -> DataFrame:
    """Adds ``slot`` to each row: 0, 1, 2, ... within its shard, without a window over a whole shard.

    Rows are counted by (shard, bucket of the key); the counts' running sums, at most shards x buckets
    of them, give each bucket its first slot and are joined back by broadcast, then rows are numbered
    within a bucket. Equal rows are counted first and numbered as a range, so that a key that repeats
    does not fill one task. All columns of rows must be orderable.
    """
    columns = rows.columns
    bucket = F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in key_columns]), F.lit(buckets)).cast("int")
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__bucket", bucket)
    sizes = rows.select(shard, bucket.alias("__bucket")).groupBy(shard, "__bucket").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(
        F.col(shard).alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first")
    )
    within = Window.partitionBy(shard, "__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    joined = placed.join(F.broadcast(first), F.col(shard).eqNullSafe(F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
    begin = F.col("__first") + F.col("__at")
    # A row that repeats is numbered in ranges of bounded length, so that no array holds them all.
    ranges = joined.select(*columns, begin.alias("__begin"), "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / RANGE))).alias("__range"))
    first, last = F.col("__range") * RANGE, F.least(F.col("__range") * RANGE + RANGE, F.col("__n")) - 1
    return ranges.select(*columns, F.explode(F.sequence(F.col("__begin") + first, F.col("__begin") + last)).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``key``.

    size: UTF-8 bytes of the text (null: none) plus 16. text_crc32 of a null text is that of the empty
    one, 0. Repeated rows each get a slot of their own; a null doc_id is a key like any other.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digests = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    slots = with_slots(with_shards(digests, ["doc_id"], 40), "shard", ["doc_id"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )
