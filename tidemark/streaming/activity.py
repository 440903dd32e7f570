"""Event counts per customer and time window, the same on a stored log and on a stream of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, *, customer: str, timestamp: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """customer, start and n_events of each tumbling window. On a stream, events later than `late`
    behind the newest are dropped by the watermark, which bounds the state; undated events are in no window."""
    rows = events.select(F.col(customer).alias("customer"), F.col(timestamp).cast("timestamp").alias("at"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    counted = rows.where("at is not null").groupBy("customer", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select("customer", F.col("w.start").alias("start"), "n_events")


def run_once(events: DataFrame, name: str, checkpoint: str) -> None:
    """Take all that a stream has now into the in-memory table `name`."""
    query = events.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
