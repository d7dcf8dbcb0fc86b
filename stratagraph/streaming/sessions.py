"""Live versions of the session and refresh operators with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def live_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """INC-06: sessions that close after ``idle`` without events; events later than ``late`` are dropped.

    State is one row for each open session, and the watermark bounds it.
    """
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(ts, idle).alias("w"), user).agg(F.count("*").alias("commands"), F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).alias("success_count"))
    return out.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "commands", "success_count")


def live_counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Commands in tumbling windows."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, window).alias("w"), "command").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "command", "n")


def refresh_stream(changes: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """INC-02, INC-04 as a stream: each batch of changed files is merged into the store once, then the query ends."""
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
