"""Following the journal with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import journal

SCHEMA = "synced_at string, entity string, op string, id string, sequence bigint"


def follow(spark: SparkSession, store_root: str) -> DataFrame:
    """The journal's changes as a stream; each new ``sequence=N`` folder arrives once."""
    return spark.readStream.schema(SCHEMA).parquet(f"{store_root.rstrip('/')}/journal")


def replay_to(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give ``sink`` the last operation of each id of every micro-batch, then stop."""
    return (changes.writeStream.foreachBatch(lambda batch, n: sink(journal.replay(batch), n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def idempotent(messages: DataFrame, key: str = "id", event_time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each message once, however often it is delivered within the delay."""
    return messages.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
