"""Intake as a stream: replays are dropped within a watermark, and each small batch is decided by the same batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, time: str = "received_at", lateness: str = "1 hour") -> DataFrame:
    """Files of events that come in, each event_id once within the lateness."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, lateness).dropDuplicatesWithinWatermark(["event_id"])


def resolve_stream(events: DataFrame, decide: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Decides each batch and writes it under its own number, so a batch that runs again after a failure replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
