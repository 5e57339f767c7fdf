"""Batch forms of the streaming roll-ups, so that their results can be checked by SQL."""

from pyspark.sql import functions as F

from ..sources import bindings
from ..session import scratch_folder
from ..streaming import rollups, sessions
from .registry import query
from .sqlbase import EVENTS, with_ctes

SUMS = """count(*) AS events, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases,
 CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS BIGINT) AS revenue_cents"""


@query("x_1_item_day_window", with_ctes(EVENTS, f"SELECT CAST(k AS VARCHAR) AS item_id, day, {SUMS} FROM ev GROUP BY 1, 2"))
def item_day_window(spark, sf):
    return rollups.item_day_totals(bindings.events(spark, sf))


@query("x_2_user_sessions", with_ctes(EVENTS, """
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM ev WINDOW w AS (PARTITION BY user_pseudo_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_pseudo_id ORDER BY ts, event_id) AS sid FROM g)""",
      f"SELECT user_pseudo_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, {SUMS} FROM s GROUP BY user_pseudo_id, sid"))
def user_sessions(spark, sf):
    out = rollups.user_sessions(bindings.events(spark, sf))
    return out.select("user_pseudo_id", F.unix_micros("session_start").alias("start_us"), "events", "views", "carts", "purchases", "revenue_cents")


SLICES = 4   # files that the stream takes one after the other


@query("x_2_streamed_sessions", with_ctes(EVENTS, """
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM ev WINDOW w AS (PARTITION BY user_pseudo_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_pseudo_id ORDER BY ts, event_id) AS sid FROM g)""",
      f"SELECT user_pseudo_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, {SUMS} FROM s GROUP BY user_pseudo_id, sid"))
def streamed_sessions(spark, sf):
    """The events arrive as files in the order of time; sessions cross their borders."""
    events, folder = bindings.events(spark, sf), scratch_folder(spark)
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    second = lambda t: F.unix_micros(t) / 1e6
    if ends["a"] is not None:
        span = events.agg((second(F.max("ts")) - second(F.min("ts"))).alias("s")).first()["s"] or 1.0
        place = F.least(F.floor((second("ts") - second(F.lit(ends["a"]))) / span * SLICES), F.lit(SLICES - 1))
        for k in range(SLICES):
            events.where(place == k).write.mode("append").parquet(f"{folder}/events")
    else:
        events.write.parquet(f"{folder}/events")
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, events.rdd.getNumPartitions())).parquet(f"{folder}/events")
    found = sessions.run(files, sessions.SessionTables(f"{folder}/sessions"), f"{folder}/marks")
    return found.select("user_pseudo_id", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("last_us"), *sessions.TOTALS)
