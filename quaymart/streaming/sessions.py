"""User sessions from a stream of events, with the state in tables of the shared folder.

Every micro-batch is folded first: a user's events of one minute become one fragment by partial aggregation, so a user with a third of all
events brings at most as many fragments as the batch has minutes. Fragments are merged with the open sessions
of the batch before; sessions whose gap lies behind the watermark are closed and appended to the result, the others stay open. An
event that is later than the watermark and touches no open session opens one of its own, which closes at once and is marked ``late``.

Both tables have one folder per batch, written whole. A batch that runs again after a failure finds the state of the batch before it
and overwrites its own folders by equal ones, so the result holds every event exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOTALS = ("events", "views", "carts", "purchases", "revenue_cents")
SCHEMA = "user_pseudo_id string, first timestamp, last timestamp, events long, views long, carts long, purchases long, revenue_cents long, late int"


def fragments(events: DataFrame) -> DataFrame:
    """One row per user and minute: first and last event and the totals between them."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events.where("ts IS NOT NULL").groupBy("user_pseudo_id", F.date_trunc("minute", "ts").alias("_minute")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"), kind("view").alias("views"), kind("click").alias("carts"),
        kind("purchase").alias("purchases"), F.sum(F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0)).cast("bigint").alias("revenue_cents")).drop("_minute")


def merged(parts: DataFrame, gap: str) -> DataFrame:
    """Fragments less than ``gap`` apart become one. A fragment is at most a minute, or a session, long; both are shorter than their gaps."""
    user = Window.partitionBy("user_pseudo_id").orderBy("first", "last")
    seen = F.max("last").over(user.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("first") >= seen + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(0))
    run = F.sum("_new").over(user.rowsBetween(Window.unboundedPreceding, 0))
    numbered = parts.withColumn("_new", starts).withColumn("_run", run)
    return numbered.groupBy("user_pseudo_id", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).cast("bigint").alias(c) for c in TOTALS],
                                                          F.min("late").alias("late")).drop("_run")


@dataclass(frozen=True)
class SessionTables:
    """Folders of the open and the closed sessions of a stream; ``late_by`` is how far the watermark lies behind the newest event."""

    folder: str
    gap: str = "30 minutes"
    late_by: str = "1 hour"

    def _of(self, spark: SparkSession, kind: str, batch: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(f"{self.folder}/{kind}/batch={batch}")

    def fold(self, batch: DataFrame, number: int) -> None:
        """The work of one micro-batch (``foreachBatch``)."""
        spark = batch.sparkSession
        before = self._of(spark, "open", number - 1) if number else spark.createDataFrame([], SCHEMA)
        limit = spark.read.schema("mark timestamp").parquet(f"{self.folder}/marks/batch={number - 1}") if number else spark.createDataFrame([], "mark timestamp")
        own = fragments(batch).crossJoin(F.broadcast(limit.agg(F.max("mark").alias("_mark"))))   # one row
        late = F.coalesce((F.col("first") < F.col("_mark")).cast("int"), F.lit(0))
        parts = own.withColumn("late", late).drop("_mark").select(before.columns).unionByName(before)
        sessions = merged(parts, self.gap)
        newest = batch.agg(F.max("ts").alias("m")).select((F.col("m") - F.expr(f"INTERVAL {self.late_by}")).alias("mark"))
        newest.unionByName(limit).agg(F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={number}")
        mark = F.broadcast(spark.read.schema("mark timestamp").parquet(f"{self.folder}/marks/batch={number}"))
        over = F.coalesce(F.col("last") + F.expr(f"INTERVAL {self.gap}") <= F.col("mark"), F.lit(False))
        told = sessions.crossJoin(mark).withColumn("_over", over).drop("mark")
        told.write.mode("overwrite").partitionBy("_over").parquet(f"{self.folder}/split/batch={number}")
        split = spark.read.schema(f"{SCHEMA}, _over boolean").parquet(f"{self.folder}/split/batch={number}")
        for kind, kept in (("closed", split.where("_over")), ("open", split.where("NOT _over"))):
            kept.drop("_over").write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={number}")

    def sessions(self, spark: SparkSession, last: int | None) -> DataFrame:
        """All closed sessions and those still open after batch ``last``."""
        if last is None:
            return spark.createDataFrame([], SCHEMA)
        closed = spark.read.schema(f"{SCHEMA}, batch int").option("basePath", f"{self.folder}/closed").parquet(f"{self.folder}/closed").where(F.col("batch") <= last)
        return closed.drop("batch").unionByName(self._of(spark, "open", last))


def run(stream: DataFrame, tables: SessionTables, checkpoint: str) -> DataFrame:
    """Drive the stream until its input is used up; all sessions."""
    done: list[int] = []

    def fold(batch: DataFrame, number: int) -> None:
        tables.fold(batch, number)
        done.append(number)

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return tables.sessions(stream.sparkSession, max(done, default=None))
