"""Late quote revisions as a stream.

Revisions arrive as files, in any order. The stream keeps no state: every landed row carries the version of its value, so a
micro-batch is reduced and merged into the months it touches by comparing versions, whichever query brings it and however late. A month is replaced at
once or not at all, together with the number of the batch, so a batch that broke off or is replayed is merged once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..session import Landing
from ..sources.versioned import VersionedTable

PARTITION = "month"
Combine = Callable[[DataFrame, Sequence[str]], DataFrame]


def revision_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as revisions: user as bond, value as the revised quote."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("bond_id"), "event_type", "value")


def newest_by_day(stream: DataFrame) -> DataFrame:
    """Revisions as landed rows: the value of a bond and day, one update, and its version (``ts, event_id``)."""
    return stream.select("bond_id", F.col("ts").cast("date").alias("date"), F.col("value").alias("clean"), F.lit(1).cast("long").alias("updates"), "ts", "event_id")


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest value per key, updates counted. Associative and order-free; updates that are delivered by two queries count twice."""
    best = F.max(F.struct("ts", "event_id", "clean")).alias("b")
    return rows.groupBy(*keys).agg(best, F.sum("updates").alias("updates")).select(*keys, "b.clean", "updates", "b.ts", "b.event_id")


def daily_totals(stream: DataFrame) -> DataFrame:
    """Revisions as landed rows: count and cents of an event type and day."""
    return stream.select(F.col("ts").cast("date").alias("window_start"), "event_type", F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def added(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and cents added up per key."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def landed_table(revisions: DataFrame, target: str, day: str) -> VersionedTable:
    """The landed table of a stream, by month of ``day``."""
    return VersionedTable(revisions.sparkSession, target, revisions.withColumn(PARTITION, month_start(F.col(day))).schema, PARTITION)


def start_topup(revisions: DataFrame, target: str, checkpoint: str, keys: Sequence[str], day: str, combine: Combine = newest):
    """Merge every micro-batch into the months of ``target`` that it touches; only these are read and replaced, replaced ones are deleted."""
    table, land = landed_table(revisions, target, day), Landing(revisions.sparkSession)

    def merge(batch: DataFrame, batch_id: int) -> None:
        if table.applied(checkpoint, batch_id):
            return
        fresh = land(combine(batch, keys).withColumn(PARTITION, month_start(F.col(day))))
        touched = [r[PARTITION] for r in fresh.select(PARTITION).distinct().collect()]  # bounded by the calendar
        merged = combine(table.read(touched).unionByName(fresh), keys).withColumn(PARTITION, month_start(F.col(day)))
        table.publish(merged, touched, checkpoint, batch_id)
        table.expire()

    return revisions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(revisions: DataFrame, root: str, keys: Sequence[str], day: str, combine: Combine = newest) -> DataFrame:
    """Run the top-up over what has arrived and return the landed table."""
    start_topup(revisions, f"{root}/table", f"{root}/checkpoint", keys, day, combine).awaitTermination()
    return landed_table(revisions, f"{root}/table", day).read().drop(PARTITION)


def run_topup_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the event files as quote revisions."""
    return drain(newest_by_day(revision_stream(spark, f"{sf_dir}/events*.parquet")), Landing(spark).root, ["bond_id", "date"], "date")


def run_windowed_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the event files as daily totals."""
    totals = drain(daily_totals(revision_stream(spark, f"{sf_dir}/events*.parquet")), Landing(spark).root, ["window_start", "event_type"], "window_start", added)
    return totals.withColumn("total", F.col("cents") / 100.0)
