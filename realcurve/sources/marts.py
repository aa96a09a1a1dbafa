"""Marts published in two formats at once.

A version of a mart is written to a folder of its own, as Parquet and as CSV, and both copies are read back and compared with each other by row
count and by a hash of their rows. Only then its manifest, one small file, is written: readers take the newest version with a manifest, so a
crash on the way leaves the one before in place in both formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "csv")
MANIFEST = "rows long, digest string, kind string"
#: So that a text comes back as it was, line ends, quotes, outer spaces and empty strings included. Null is written as a mark that no text may be.
CSV = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash of them that doesn't depend on their order: the sum of the rows' hashes."""
    one = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.concat_ws(",", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns]))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("h")).first()
    return row["n"], str(row["h"] or 0)


class Mart:
    """A mart under ``root``: ``version=N/parquet``, ``version=N/csv`` and ``manifest/version=N``. Columns are of simple types, and
    no text is the mark of null. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        """``version, rows, digest, kind`` of every published version."""
        kind = f"{MANIFEST}, version long"
        return self.spark.read.schema(kind).parquet(f"{self.root}/manifest") if self._exists(f"{self.root}/manifest") else self.spark.createDataFrame([], kind)

    def version(self) -> int:
        """The version that readers see; -1 before the first."""
        found = self.manifest().agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def _copy(self, version: int, kind: StructType, form: str) -> DataFrame:
        reader = self.spark.read.schema(kind)
        return reader.options(**CSV, multiLine=True).csv(f"{self.root}/version={version}/csv") if form == "csv" else reader.parquet(f"{self.root}/version={version}/parquet")

    def publish(self, df: DataFrame) -> int | None:
        """Write, verify and show a new version; an empty frame is skipped (None)."""
        version = self.version() + 1
        at = f"{self.root}/version={version}"
        df.write.mode("overwrite").parquet(f"{at}/parquet")
        written = self._copy(version, df.schema, "parquet")
        if written.isEmpty():
            return None
        self._write_csv(written, f"{at}/csv")
        rows, hashed = digest(written)
        if (rows, hashed) != digest(self._copy(version, df.schema, "csv")):
            raise ValueError(f"the two copies in {at} differ")
        row = self.spark.createDataFrame([(rows, hashed, df.schema.json())], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return version

    def _write_csv(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").options(**CSV).csv(path)

    def read(self, form: str = "parquet") -> DataFrame:
        """The newest published version in one of the formats."""
        if form not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}, not {form!r}")
        last = self.manifest().orderBy(F.col("version").desc()).first()
        if last is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        import json

        return self._copy(last["version"], StructType.fromJson(json.loads(last["kind"])), form)

    def expire(self, keep: int = 1) -> None:
        """Delete the copies of all published versions but the last ``keep``."""
        for r in self.manifest().orderBy(F.col("version").desc()).collect()[keep:]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/version={r['version']}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def write_mart(df: DataFrame, path: str) -> bool:
    """Publish a mart in both formats; whether there was anything to publish."""
    return Mart(df.sparkSession, path).publish(df) is not None
