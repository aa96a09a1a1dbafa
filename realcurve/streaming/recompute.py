"""Returns kept up to date with revised quotes.

Three tables by bucket of bonds: quotes with their versions, returns, and month marks. A batch of revisions is merged into the quotes of the
buckets it touches; bonds whose values change are walked again from the month of their first changed day, and their buckets are replaced. Quotes are
published last, with the batch's number: a batch that broke off is found not applied and goes through again, with the same result, because the marks from
before the changed months are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, walk
from ..session import Landing
from ..sources.versioned import VersionedTable, bucket_of

VALUES = ["clean", "ytm", "vendor_ir"]
QUOTE = ["bond_id", "date", *VALUES, *incremental.VERSION]
PART = "bucket"


class ReturnStore:
    """Quotes, returns and marks under ``root``. ``value`` turns quotes into metrics, row by row (see ``walk.value_quotes``).

    ``buckets`` belongs to the tables and stays theirs; by default it is what a shuffle of this session has.
    """

    def __init__(self, spark: SparkSession, root: str, value: Callable[[DataFrame], DataFrame], buckets: int | None = None):
        self.spark, self.root, self.value, self.land = spark, root, value, Landing(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, VersionedTable] = {}

    def _table(self, name: str, like: DataFrame) -> VersionedTable:
        if name not in self.tables:
            self.tables[name] = VersionedTable(self.spark, f"{self.root}/{name}", like.schema, PART)
        return self.tables[name]

    def _parted(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, bucket_of(F.col("bond_id"), self.buckets))

    def _walk(self, quotes: DataFrame, seeds: DataFrame) -> DataFrame:
        """Quotes (with their bucket) walked on from the seeds: one shuffle, of the quotes as they are."""
        return incremental.walk_tail(self.value(incremental.seeded(quotes.select(PART, "bond_id", "date", *VALUES), seeds, PART)), PART)

    def build(self, quotes: DataFrame) -> None:
        """Everything from the quotes as they are (``bond_id, date, clean, ytm, vendor_ir``), without versions."""
        unversioned = {"ts": F.lit(None).cast("timestamp"), "event_id": F.lit(None).cast("long"), "changed": F.lit(False)}
        first = self._parted(quotes.withColumns(unversioned).select(*QUOTE, "changed"))
        kept = self._table("quotes", first).stage(first)
        seed = ", ".join(f"{c} {t}" for c, t in zip(incremental.SEED, ("date", "date", "double", "double", "int", "double")))
        walked = self._walk(kept, self.spark.createDataFrame([], f"{PART} int, bond_id {kept.schema['bond_id'].dataType.simpleString()}, {seed}"))
        walked = self._table("returns", walked).stage(walked, placed=True)
        marks = incremental.marks_of(walked)
        self._table("marks", marks).stage(marks, placed=True)
        for name in ("returns", "marks", "quotes"):
            self.tables[name].publish(None)

    def apply(self, revisions: DataFrame, batch: int, source: str = "revisions") -> None:
        """Merge one batch of revisions (``bond_id, date, clean, ytm, vendor_ir, ts, event_id``) and walk the bonds that it changes."""
        quotes, returns, marks = (self.tables[n] for n in ("quotes", "returns", "marks"))
        if quotes.applied(source, batch):
            return
        fresh = self.land(self._parted(incremental.newest_cells(revisions.select(*QUOTE), ["bond_id", "date"], VALUES)))
        parts = [r[PART] for r in fresh.select(PART).distinct().collect()]  # no more than there are buckets
        old = quotes.read(parts).drop("changed")
        merged = quotes.stage(incremental.merged_cells(old, fresh, [PART, "bond_id", "date"], VALUES, PART), placed=True)
        dirty = self.land(incremental.dirty_bonds(merged))
        walked = [r[PART] for r in dirty.select(bucket_of(F.col("bond_id"), self.buckets).alias(PART)).distinct().collect()]
        if walked:
            seeds = self._parted(incremental.seeds_of(marks.read(walked).drop(PART), dirty))
            tail = merged.join(dirty, "bond_id").where(F.col("date") >= F.col("from_month"))
            left = {t: incremental.outside(t.read(walked), dirty, day) for t, day in ((returns, "date"), (marks, "month"))}
            again = returns.stage(self._walk(tail, seeds), placed=True)
            marks.stage(incremental.marks_of(again), placed=True)
            for table, rows in left.items():
                table.stage(rows, placed=True, more=True)
                table.publish(None, walked)
        quotes.publish(None, parts, source, batch)

    def expire(self) -> None:
        """Delete replaced parts."""
        for t in self.tables.values():
            t.expire()

    def read(self) -> DataFrame:
        return incremental.returns_of(self.tables["returns"].read())


def drain(store: ReturnStore, revisions: DataFrame, checkpoint: str):
    """Apply all files of revisions that have arrived, batch by batch; the stream holds no state."""
    query = revisions.writeStream.foreachBatch(lambda batch, n: store.apply(batch, n, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
