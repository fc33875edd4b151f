"""A maintained symbol table: listings of a source tree come as a stream, and each one replaces what changed since the one before.

A listing is a full state of the tree: snapshot (a number that grows), path, hash, content.
Files that a listing lacks are deleted, which no file source tells. The folder holds,
by micro-batch, the listing's hashes, the events and the rows of the buckets that they
touch; rows of other buckets stay where they are. A batch that is run again overwrites
its own parts from the state before it, and a restart goes on where the checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.sources.storage import cut


#: Buckets of files whose rows are rewritten together.
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("file_path"), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _read(spark: SparkSession, path: str, schema: T.StructType, *parts: str) -> DataFrame:
    """A folder of partitions by number, of the schema; empty if it isn't there."""
    whole = T.StructType([*schema.fields, *(T.StructField(p, T.IntegerType()) for p in parts)])
    return spark.read.schema(whole).parquet(path) if _exists(spark, path) else spark.createDataFrame([], whole)


_HASHES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("hash", T.StringType())])
_EVENTS = T.StructType([*_HASHES.fields, T.StructField("event", T.StringType())])
_TOUCHED = T.StructType([T.StructField("bucket", T.IntegerType())])


def compare(before: DataFrame, now: DataFrame) -> DataFrame:
    """file_path, hash, event of two listings (file_path, hash): `created`, `changed` (another hash) or `deleted` (with its last hash)."""
    both = before.select("file_path", F.col("hash").alias("old")).join(now.select("file_path", F.col("hash").alias("new")), "file_path", "full")
    event = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("file_path", F.coalesce("new", "old").alias("hash"), event.alias("event")).where("event is not null")


class Watch:
    """A symbol table in a folder of shared storage, kept by listings.

    build(files: file_path, content) gives rows of schema with a file_path.
    also(rows, changed: file_path) names further files (file_path) to build anew, such
    as those that depend on changed ones; none by default.
    """

    def __init__(self, spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame], schema: T.StructType, also: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.build, self.schema, self.also = spark, folder, build, schema, also

    def _rows(self, before: int | None = None) -> DataFrame:
        """The rows as they stand, or stood before a batch: each bucket's newest version."""
        touched = _read(self.spark, f"{self.folder}/touched", _TOUCHED, "batch")
        rows = _read(self.spark, f"{self.folder}/rows", self.schema, "batch", "bucket")
        if before is not None:
            touched, rows = touched.where(F.col("batch") < before), rows.where(F.col("batch") < before)
        newest = touched.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(newest), ["bucket", "batch"], "left_semi").select(*self.schema.names)  # a row per bucket

    def rows(self) -> DataFrame:
        return self._rows()

    def events(self) -> DataFrame:
        """file_path, hash, event, batch of all that was seen."""
        return _read(self.spark, f"{self.folder}/events", _EVENTS, "batch")

    def _listing(self, before: int) -> DataFrame:
        kept = _read(self.spark, f"{self.folder}/listings", _HASHES, "batch").where(F.col("batch") < before)
        last = kept.agg(F.max("batch").alias("batch"))
        return kept.join(F.broadcast(last), "batch", "left_semi").where("file_path is not null").select("file_path", "hash")

    def apply(self, arrived: DataFrame, batch: int) -> None:
        """Take the newest listing of a micro-batch (snapshot, file_path, hash, content); older ones in it are passed over."""
        newest = arrived.agg(F.max("snapshot").alias("snapshot"))
        now = arrived.join(F.broadcast(newest), "snapshot", "left_semi").where("file_path is not null").dropDuplicates(["file_path"])
        if arrived.isEmpty():
            return
        part = f"batch={batch}"
        events = cut(compare(self._listing(batch), now.select("file_path", "hash")))
        old = self._rows(batch)
        changed = events.select("file_path")
        wanted = changed if self.also is None else cut(changed.union(self.also(old, changed).select("file_path")).distinct())
        touched = cut(wanted.select(_bucket().alias("bucket")).distinct())
        fresh = self.build(now.join(wanted, "file_path", "left_semi").select("file_path", "content")).select(*self.schema.names)
        kept = old.withColumn("bucket", _bucket()).join(F.broadcast(touched), "bucket", "left_semi").join(wanted, "file_path", "left_anti").select(*self.schema.names)
        kept.unionByName(fresh).withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/{part}")
        events.write.mode("overwrite").parquet(f"{self.folder}/events/{part}")
        mark = self.spark.createDataFrame([(None, None)], _HASHES)  # an empty listing is one, too
        now.select("file_path", "hash").union(mark).write.mode("overwrite").parquet(f"{self.folder}/listings/{part}")
        touched.write.mode("overwrite").parquet(f"{self.folder}/touched/{part}")  # last: it makes the rows count

    def drain(self, listings: DataFrame) -> None:
        """Take all listings that have arrived, a stream of (snapshot, file_path, hash, content)."""
        listings.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(self.apply).start().awaitTermination()

    def follow(self, listings: DataFrame, every: str = "1 second"):
        """The running query that takes listings as they come; what comes within one interval counts as its newest state."""
        return listings.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=every).foreachBatch(self.apply).start()


def history(listings: DataFrame) -> DataFrame:
    """snapshot, file_path, hash, event: what a stream of all listings (snapshot, file_path, hash) would see, by snapshot, in one batch job.

    Snapshots are compared with the one before them in the table; the first creates all. A
    row without a path only tells that there is such a snapshot.
    """
    order = listings.select("snapshot").distinct()
    ranked = order.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("snapshot")))  # a row per snapshot
    placed = listings.select("snapshot", "file_path", "hash").distinct().where("file_path is not null").join(F.broadcast(ranked), "snapshot")
    before = placed.select((F.col("at") + 1).alias("at"), "file_path", F.col("hash").alias("old"))
    both = placed.select("at", "file_path", F.col("hash").alias("new")).join(before, ["at", "file_path"], "full")
    event = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    named = both.select("at", "file_path", F.coalesce("new", "old").alias("hash"), event.alias("event")).where("event is not null")
    # what the last snapshot holds isn't deleted behind it
    return named.join(F.broadcast(ranked), "at").select("snapshot", "file_path", "hash", "event")
