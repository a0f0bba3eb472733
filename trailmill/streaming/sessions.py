"""Streaming extensions; the batch operators are their definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, delay: str = "3 days", key: str = "event_id", at: str = "ts") -> DataFrame:
    """Each event once, however often polling windows deliver it; state is dropped after the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def session_windows(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour", at: str = "ts") -> DataFrame:
    """(user_id, start, end, n, value) of sessions closed by a gap; events later than the delay are dropped.

    delay is None for events that have their watermark already.
    """
    s = F.session_window(at, gap)
    timed = events if delay is None else events.withWatermark(at, delay)
    return timed.groupBy(F.col("user_id"), s.alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")


def running_statistics(events: DataFrame) -> DataFrame:
    """Counts and sums by event type, for complete or update mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, through the stream's plan into a table in memory: for tests and small demonstrations."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return df.sparkSession.table(name)
