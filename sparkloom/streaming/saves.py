"""Saves of files as a stream: analysis on arrival, and a keyed store with a time to live."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

TTL_MINUTES = 30


def on_save(spark: SparkSession, folder: str, schema: StructType, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, enabled: bool = True) -> StreamingQuery | None:
    """Runs ``analyse`` over each batch of files that arrive in folder (parquet) and appends its rows to ``out``.

    A batch that is run again after a failure replaces what it wrote: its rows go to a folder of its own.
    """
    if not enabled:
        return None
    saves = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return saves.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_hits(saves: DataFrame, key: str, at: str, order: str, hash_: str, ttl_minutes: int = TTL_MINUTES, lateness: str | None = None) -> DataFrame:
    """(key, order, hit) of a streaming frame: a save hits if the key's last one had the same hash and is young enough.

    State: hash and time of the key's last save; each save refreshes it. ``key``, ``order`` are BIGINT.
    A tombstone (null hash, an undo) drops the key's state. Saves of a batch are taken in the order of
    time. With ``lateness`` (as "10 minutes") saves later than that are dropped, and so is the state of
    keys that were silent for the time to live; without, such state stays and is outdated when they come back.
    """
    rows = saves.select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("ord"), F.col(at).cast("timestamp").alias("at"), F.col(hash_).cast("string").alias("hash"))

    if lateness is not None:
        rows = rows.withWatermark("at", lateness)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_hash, last_at = state.get if state.exists else (None, None)
        pdf = pd.concat(list(frames)).sort_values(["at", "ord"])
        hits = []
        for t, h in zip(pdf["at"], pdf["hash"]):
            micros = int(pd.Timestamp(t).value // 1000)
            hits.append(last_hash is not None and h == last_hash and micros - last_at < ttl_minutes * 60_000_000)
            last_hash, last_at = h, micros
        if last_hash is None:
            if state.exists:
                state.remove()
        else:
            state.update((last_hash, last_at))
            if lateness is not None:
                state.setTimeoutTimestamp(max(last_at // 1000 + ttl_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "ord": pdf["ord"].to_numpy(), "hit": hits})

    return rows.groupBy("key").applyInPandasWithState(step, "key bigint, ord bigint, hit boolean", "hash string, at bigint", "append", GroupStateTimeout.NoTimeout if lateness is None else GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote below folder (a shared one on a cluster)."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
