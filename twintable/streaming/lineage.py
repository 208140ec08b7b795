"""Lineage roll-up over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rollup(events: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Per day, edge: ``day, source, target, first_seen, last_seen, event_count``; events without both ends are left out.

    Append mode emits a day once the watermark has passed it; the union of days rolls up to what the batch
    operator gives, as minimum, maximum and count add up.
    """
    e = events.select(
        F.col("source_table_full_name").alias("source"), F.col("target_table_full_name").alias("target"), F.col("event_time").cast("timestamp").alias("t")
    ).where("source is not null and target is not null and t is not null")
    days = e.withWatermark("t", lateness).groupBy(F.window("t", window).alias("w"), "source", "target")
    out = days.agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("event_count"))
    return out.select(F.col("w.start").alias("day"), "source", "target", "first_seen", "last_seen", "event_count")
