"""The latest row per key of a stream, kept in the shared folder.

Each micro-batch writes the keys it touched as one version, in hash buckets; every so many
batches a version with all keys replaces what came before. A batch reads the newest whole
version and the later ones, and of these only the buckets its own keys fall into. Versions go by
batch number and a batch reads only earlier ones, so a batch that is run again finds what it found
at first and overwrites what it had written.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BUCKETS, EVERY = 64, 16
BUCKET, BATCH = "_bucket", "_batch"
#: Behind all batches.
LAST = 2 ** 62


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


class KeyedTable:
    """``columns`` (a schema string) of the latest row per ``key``, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int = BUCKETS,
                 every: int = EVERY):
        self.spark, self.path, self.key, self.buckets, self.every = spark, path, key, buckets, every
        self.schema = T.StructType.fromDDL(columns)

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, bool]]:
        """(batch, whole) of the complete versions, in order."""
        _, system = self._folder()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted((int(found[2]), found[1] == "all") for name in folders(self.spark, self.path)
                      if (found := re.fullmatch(r"(all|new)-(\d+)", name))
                      and system.exists(path(f"{self.path}/{name}/_SUCCESS")))

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, before: int, keys: DataFrame | None = None) -> DataFrame:
        """The table as batches before this one left it; with ``keys``, only their buckets."""
        versions = [v for v in self.versions() if v[0] < before]
        whole = max((batch for batch, all_ in versions if all_), default=-1)
        wanted = ([("all", whole)] if whole >= 0 else []) + [("new", b) for b, all_ in versions if not all_ and b > whole]
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for kind, batch in wanted:
            part = self.spark.read.schema(stored).parquet(f"{self.path}/{kind}-{batch}").withColumn(BATCH, F.lit(batch))
            rows = part if rows is None else rows.unionByName(part)
        if keys is not None:
            # At most as many numbers as there are buckets.
            touched = [r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()]
            rows = rows.where(F.col(BUCKET).isin(touched))
        latest = F.max_by(F.struct(*[c for c in self.schema.names if c != self.key]), BATCH).alias("_row")
        return rows.groupBy(self.key).agg(latest).select(self.key, "_row.*").select(*self.schema.names)

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.select(*self.schema.names).withColumn(BUCKET, self.bucket(F.col(self.key))).repartition(BUCKET)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{name}"))

    def write(self, rows: DataFrame, batch: int, keep: Column | None = None) -> None:
        """Add a batch's rows, one per key. When all versions are folded, keys that do not meet
        ``keep`` are forgotten."""
        self._write(rows, f"new-{batch}")
        if (batch + 1) % self.every:
            return
        folded = self.read(batch + 1)
        self._write(folded.where(keep) if keep is not None else folded, f"all-{batch}")
        # The version before stays, for a batch that is run again.
        folds = [b for b, all_ in self.versions() if all_]
        if len(folds) > 1:
            path, system = self._folder()
            for b, all_ in self.versions():
                if b < folds[-2] or (b == folds[-2] and not all_):
                    system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{'all' if all_ else 'new'}-{b}"), True)
