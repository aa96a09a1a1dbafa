"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import realcurve
from realcurve.session import Landing

#: Fixed value: what separates words.
SPACE = r"[\x20\x09-\x0D]+"


class Land(Landing):
    """Writes a frame to the shared checkpoint folder and reads it back, see ``Landing``."""

    def path(self) -> str:
        """A folder of the shared one that nothing is in yet."""
        self.count += 1
        return f"{self.root}/{self.count:03d}"

    def compressed(self, df: DataFrame) -> DataFrame:
        """As a call, smaller on disk and slower to write."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landing(spark: SparkSession) -> Land:
    return Land(spark)


_SHIPPED: set[str] = set()


def with_code(spark: SparkSession) -> SparkSession:
    """The session, its Python workers able to import this package: its sources are added to the application once, as --py-files would.

    Rows may be long texts, so where the session has the usual number of rows of an Arrow batch, it gets a smaller one.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root, held = Path(realcurve.__file__).parent, io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        file = os.path.join(tempfile.mkdtemp(prefix="realcurve-code-"), "realcurve.zip")
        Path(file).write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(file)
        _SHIPPED.add(app)
    return spark


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def slots(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_below(bounds: list, value: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b) for b in bounds])

    def step(low: Column, s: Column) -> Column:
        return F.when((low + s <= len(bounds)) & (F.get(held, low + s - 1) < value), low + s).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def quantile_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """Ascending distinct bounds that cut a whole-number column into about equal buckets; as many values as buckets reach the driver."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 4 * buckets)).alias("b")).first()["b"]
    return sorted(set(found or []))


def components(edges: DataFrame, land: Land) -> DataFrame:
    """``node, component`` (the least reachable node) of the undirected ``src, dst`` edges; nodes without an edge are left out.

    Each round takes the least label of all neighbours and then the label of the label, so chains shrink geometrically. Rounds are
    written tables: nothing is collected, and a lost executor repeats only its share of the last round.
    """
    both = land(edges.where("src <> dst").select("src", "dst").union(edges.where("src <> dst").select("dst", "src")).distinct())
    labels = land(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    before = labels.agg(total.alias("t")).first()["t"]
    while before is not None:
        seen = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        near = labels.join(seen, "node").select("node", F.least("component", "near").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = land(near.join(far, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")))
        after = labels.agg(total.alias("t")).first()["t"]
        if after == before:
            break
        before = after
    return labels
