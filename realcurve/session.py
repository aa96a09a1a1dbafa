"""Session defaults shared by tests, the bench and ad-hoc runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "realcurve") -> SparkSession:
    """A local session with the settings the plans assume (AQE on, UTC dates)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("REALCURVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch folder only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="realcurve-"))
        current = sc.getCheckpointDir()
    return current


class Landing:
    """Writes small intermediate tables to the shared checkpoint folder and reads them back.

    A written table cuts the lineage, survives lost executors and gives the optimizer its true size.
    Meant for frames bounded by the calendar that later steps read several times.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/realcurve-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        """A folder of the shared one that nothing is in yet."""
        self.count += 1
        return f"{self.root}/{self.count:03d}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def unsettled(df: DataFrame) -> DataFrame:
    """The default of operators that accept a landing step: leave the plan as it is."""
    return df
