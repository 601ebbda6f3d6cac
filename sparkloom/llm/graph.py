"""Connected components over an edge table, in bounded memory and a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't the smallest of its component.

    Alternates large-star and small-star rounds until the edges no longer change: each is a join of
    the edges with one minimum per node, so a hub is a skewed join that AQE splits, not a group that
    has to fit into a task. Self loops and repeated edges do no harm; null ends are dropped.
    """
    e = settle(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before = _mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        )
        large = settle(large.distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w")
        starred = large.join(low, F.col("hi") == F.col("w"))
        e = settle(
            starred.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
