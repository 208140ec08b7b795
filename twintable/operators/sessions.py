"""Splitting each user's events into visits separated by inactivity, as merging intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_text(us: Column) -> Column:
    """Microseconds since 1970 as 'yyyy-MM-dd HH:mm:ss.SSS'."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSS")


def gap_us(gap_minutes: float) -> int:
    return int(gap_minutes * 60_000_000)


def distinct_events(events: DataFrame, user: str = "user_id", ts: str = "event_timestamp", event_id: str = "event_id") -> DataFrame:
    """``event, user, us, n``: usable events, redelivered ones once (``n`` counts the rows of a null id).

    Spread by all three columns, so a hot user is no hot task.
    """
    e = events.select(F.col(user).alias("user"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).alias("event"))
    once = e.where("user is not null and user <> '' and us is not null").groupBy("event", "user", "us").agg(F.count("*").alias("n"))
    return once.withColumn("n", F.when(F.col("event").isNull(), F.col("n")).otherwise(1))


def opened_intervals(events: DataFrame, gap: int) -> DataFrame:
    """``user, lo, hi, n``: the intervals that events open, those within one slot of a gap's length merged already.

    Any two events of a slot are less than a gap apart, so a map-side partial aggregate merges them. A user has
    at most one interval per gap of elapsed time, whatever the number of events.
    """
    slot = F.floor(F.col("us") / F.lit(gap)).alias("slot")
    return events.groupBy("user", slot).agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.sum("n").alias("n")).drop("slot")


def merge_intervals(intervals: DataFrame, gap: int) -> DataFrame:
    """``user, lo, hi, n``: overlapping and touching intervals [lo, hi + gap] of a user merged into one.

    Intervals come in order of their start; one that starts after the furthest end so far opens a visit.
    """
    order = Window.partitionBy("user").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.lit(gap)
    opens = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    marked = intervals.select("user", "lo", "hi", "n", opens.alias("opens")).withColumn("visit", F.sum("opens").over(order))
    return marked.groupBy("user", "visit").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("visit")


def sessionize(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "event_timestamp",
    event_id: str = "event_id",
    gap_minutes: float = 30,
) -> DataFrame:
    """One row per visit: ``user, start_us, end_us, duration_us, event_count`` (microseconds since 1970).

    Every event opens an interval as long as the gap; overlapping or touching intervals of a user merge, so
    events exactly one gap apart stay together. This is the interval state of ``streaming.sessions`` over one
    batch, which no watermark closes early: order of arrival does not matter, late events count like others.

    Defined cases: rows with a null or empty user or a null time are left out; rows equal in id, user and time
    are one event; a null id never equals another; no rows give no visits; other columns are ignored.
    """
    gap = gap_us(gap_minutes)
    return as_visits(merge_intervals(opened_intervals(distinct_events(events, user, ts, event_id), gap), gap), user)


def as_visits(intervals: DataFrame, user: str = "user_id") -> DataFrame:
    return intervals.select(
        F.col("user").alias(user), F.col("lo").alias("start_us"), F.col("hi").alias("end_us"), (F.col("hi") - F.col("lo")).alias("duration_us"), F.col("n").alias("event_count")
    )


def visits_report(visits: DataFrame, user: str = "user_id") -> DataFrame:
    """Visits with their times as text: ``user, session_start, session_end, event_count``."""
    return visits.select(
        user,
        time_text(F.col("start_us")).alias("session_start"),
        time_text(F.col("end_us")).alias("session_end"),
        F.col("event_count").cast("bigint").alias("event_count"),
    )
