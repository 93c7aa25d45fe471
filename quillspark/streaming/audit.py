"""The audit log as a stream: status timelines per document, late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows; works alike on a batch and on a stream, where late events are let in for ``late``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def last_writes(events: DataFrame) -> DataFrame:
    """(user_id, status, at, writes): the last event of each user, of equals in time the one with the greatest id. One shuffle, pre-aggregated."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("writes"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each user."""
    return last_writes(events).select("user_id", "status")


def timeline(events: DataFrame) -> DataFrame:
    """(event_id, user_id, event_type, previous, waited_us, step): each event of a user with the one before it and the time between."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    waited = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return events.select("event_id", "user_id", "event_type", F.coalesce(F.lag("event_type").over(w), F.lit("")).alias("previous"), F.coalesce(waited, F.lit(-1)).alias("waited_us"), F.row_number().over(w).cast("long").alias("step"))
