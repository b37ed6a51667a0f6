"""Tables laid out in buckets by a hash of their key: a change reads and writes the buckets that it touches, no others.

A bucket is a folder of Parquet files (``bucket=17``), written anew by Spark's dynamic partition overwrite, which puts the new
files in place when all of them are there. Changes set values by key, so that one that was broken off can be made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.operators import store
from lodemill.sources.tables import written


class Buckets:
    """A table at ``path`` with the columns of ``schema`` (DDL), in ``n`` buckets by ``key``.

    Null keys are a bucket's rows like others (the hash of null), but no change finds them, since null equals nothing. The
    number of buckets is a property of the table: it has to be the same whenever the table is opened. Readers that listed the
    files of a bucket before it was written anew have to list them again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.n = spark, path.rstrip("/"), schema, key, n
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The numbers of the buckets that hold ``keys``: at most as many as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def _files(self, bucket: int) -> dict[str, int]:
        """Names and sizes of a bucket's files; none if there is no such bucket."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {f.getPath().getName(): f.getLen() for f in fs.listStatus(at)} if fs.exists(at) else {}

    def _there(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.partition("=")[2]) for x in names if x.startswith("bucket="))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of which no other folder is listed."""
        there = self._there() if buckets is None else [b for b in buckets if self._files(b)]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/bucket={b}" for b in there]
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of all buckets that ``keys`` touch."""
        return self.read(self.touched(keys))

    def change(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """``how`` makes the new rows of the touched buckets from their old ones and the changes; the numbers of these buckets.

        ``how`` has to keep each key in place: a row that it makes has the key of an old row or of a change.
        """
        changes = written(changes, "changes")
        touched = self.touched(changes)
        before = {b: self._files(b) for b in touched}
        new = how(self.read(touched), changes).select(*self.columns).withColumn("bucket", self.bucket())
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in touched:
            if before[b] and self._files(b) == before[b]:  # nothing was put in its place: no row is left
                self._drop(b)
        return touched

    def _drop(self, bucket: int) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def upsert(self, rows: DataFrame) -> list[int]:
        """Rows with a known key replace what is not null there; the others are added. Null keys are added each time."""
        return self.change(rows, lambda old, new: store.upserted(old, new, self.key))

    def patch(self, rows: DataFrame, overwrite: tuple[str, ...] = ()) -> list[int]:
        """Values that are not null replace those of known keys; those of ``overwrite`` always do."""
        return self.change(rows, lambda old, new: store.patched(old, new, self.key, overwrite=overwrite))

    def set_status(self, changes: DataFrame) -> list[int]:
        """New statuses with their error messages; none clears the old one."""
        return self.change(changes, lambda old, new: store.with_status(old, new, self.key))

    def flag(self, keys: DataFrame, column: str, value: Column) -> list[int]:
        """``column`` set for the rows of ``keys``."""
        return self.change(keys.select(self.key), lambda old, new: store.flagged(old, new, column, value, self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        """The rows of ``keys`` go."""
        return self.change(keys.select(self.key), lambda old, new: store.deleted(old, new, self.key))

    def insert(self, rows: DataFrame, number: str) -> None:
        """New rows, told apart by ``number`` (a folder of the bucket), so that writing them again writes them over; no row is read.

        For rows whose keys are known to be new. A later change of the bucket takes them in.
        """
        out = rows.select(*self.columns).withColumn("bucket", self.bucket()).withColumn("batch", F.lit(number))
        out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)

    def inserted(self, number: str) -> DataFrame:
        """The rows that were inserted under ``number``; no other file is read."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*/batch={number}")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        paths = [f.getPath().toString() for f in found or []]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)
