"""The daily item roll-up and the user-session roll-up over an unbounded stream of events.

Both take the event rows of ``sources.bindings`` (``ts`` as a timestamp) from a batch or a stream.
State is one row per open window and key; the watermark closes windows and drops their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts():
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return [F.count("*").alias("events"), kind("view").alias("views"), kind("click").alias("carts"), kind("purchase").alias("purchases"),
            F.sum(F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0)).cast("bigint").alias("revenue_cents")]


def item_day_totals(events: DataFrame, late_by: str = "1 day") -> DataFrame:
    """Item totals per UTC day."""
    marked = events.withWatermark("ts", late_by) if events.isStreaming else events
    rows = marked.groupBy(F.window("ts", "1 day"), F.col("k").cast("string").alias("item_id")).agg(*_counts())
    return rows.select("item_id", F.to_date("window.start").alias("day"), "events", "views", "carts", "purchases", "revenue_cents")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late_by: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    marked = events.withWatermark("ts", late_by) if events.isStreaming else events
    rows = marked.groupBy(F.session_window("ts", gap), "user_pseudo_id").agg(*_counts())
    return rows.select("user_pseudo_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
                       "events", "views", "carts", "purchases", "revenue_cents")
