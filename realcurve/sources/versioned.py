"""Tables whose parts are replaced one by one, each replacement visible at once or not at all.

A table lives under one shared folder: ``data/version=N/<part>=value`` holds the parts written by version ``N``, and ``manifest/version=N`` is one small
file that names them. Writing that file is the moment of publication: a reader takes each part from its newest version that has a manifest, so a
write that broke off leaves the old parts in place and a replayed one is written over. One writer at a time.

Parts are bounded by the calendar (months) or by a chosen number of buckets, so the manifest and the list of paths are short.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "part string, rows long, source string, batch long"


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key, the same in every session."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class VersionedTable:
    """A table of ``schema`` cut into parts by the column ``by`` (a date or a whole number, one of its columns)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, by: str):
        self.spark, self.root, self.schema, self.by = spark, root.rstrip("/"), schema, by

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> DataFrame:
        """Every published part: its version, rows, and the source and batch that it came from."""
        fs, path = self._fs(f"{self.root}/manifest")
        if not fs.exists(path):
            return self.spark.createDataFrame([], f"{MANIFEST}, version long")
        return self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.root}/manifest")

    def live(self) -> dict[str, tuple[int, int]]:
        """Version and rows of each part that readers see."""
        newest = self.manifest().where("part is not null").groupBy("part").agg(F.max(F.struct("version", "rows")).alias("n"))
        return {r["part"]: (r["n"]["version"], r["n"]["rows"]) for r in newest.collect()}

    def last_version(self) -> int:
        found = self.manifest().agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def applied(self, source: str, batch: int) -> bool:
        """Whether this batch of this source has been published."""
        return self.manifest().where((F.col("source") == source) & (F.col("batch") == batch)).limit(1).count() > 0

    def read(self, parts: Iterable | None = None) -> DataFrame:
        """The table, or only the given parts of it."""
        wanted = None if parts is None else {str(p) for p in parts}
        paths = [f"{self.root}/data/version={v}/{self.by}={p}" for p, (v, rows) in sorted(self.live().items()) if rows and (wanted is None or p in wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(*paths).select(*self.schema.names)

    def stage(self, rows: DataFrame, placed: bool = False, more: bool = False) -> DataFrame:
        """Write rows of the next version, which no reader sees, and return them reread; ``more`` adds to those written before.

        ``placed``: the rows of a part lie in few tasks already, so they are written where they are.
        """
        data = f"{self.root}/data/version={self.last_version() + 1}"
        rows = rows.select(*self.schema.names)
        rows = rows if placed else rows.repartition(self.by)
        rows.write.mode("append" if more else "overwrite").option("compression", "zstd").partitionBy(self.by).parquet(data)
        return self.spark.read.schema(self.schema).parquet(data)

    def publish(self, rows: DataFrame | None, parts: Iterable | None = None, source: str | None = None, batch: int | None = None) -> int:
        """Replace parts by ``rows`` (None: by what is staged): those that they hold and all of ``parts``, which are empty from now on where no row is left."""
        version = self.last_version() + 1
        staged = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/version={version}") if rows is None else self.stage(rows)
        written = staged.groupBy(F.col(self.by).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
        held = {r["part"]: r["rows"] for r in written.collect()}
        listed = [(p, n, source, batch) for p, n in sorted(({str(p): 0 for p in parts or ()} | held).items())] or [(None, 0, source, batch)]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return version

    def expire(self, keep: int = 1) -> int:
        """Delete the data of parts that were replaced ``keep`` versions ago or earlier; the number of deleted parts."""
        last, gone = self.last_version(), 0
        for r in self.manifest().where("part is not null").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("version", "rows"))).alias("all")).collect():
            versions = [(v["version"], v["rows"]) for v in r["all"]]
            for (old, rows), (new, _) in zip(versions, versions[1:]):
                if rows and new <= last - keep + 1:
                    fs, path = self._fs(f"{self.root}/data/version={old}/{self.by}={r['part']}")
                    gone += bool(fs.delete(path, True))
        return gone
