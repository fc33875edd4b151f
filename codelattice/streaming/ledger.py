"""The ledgers as streams that resume: their tables in shared storage equal those of the batch operators.

Each stream has a folder that the caller names: the checkpoint, and one part of the
table per micro-batch, under the batch's number. A batch that is run again after a
failure overwrites its own part, and a restart goes on where the checkpoint stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.operators import ledger
from codelattice.sources.storage import shared_dir


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared storage, for a stream that nobody resumes."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the events table, one a batch; a table in one file is a stream of one batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet{{,/*.parquet}}")


def _drain(stream: DataFrame, mode: str, folder: str) -> None:
    """Run all that has arrived; each batch's rows are its part of the table."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/parts/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def _parts(spark: SparkSession, folder: str, schema) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parts")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/parts")


def daily(spark: SparkSession, events: DataFrame, folder: str | None = None, late: str = "400 days") -> DataFrame:
    """Events per day and type. Only counts that a batch changes are written.

    An event that is older than the newest one by more than `late` is not counted any
    more; counts of days before that leave the state.
    """
    folder = folder or new_folder(spark)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("start").alias("day"), "event_type", "n")
    _drain(counted, "update", folder)
    return _parts(spark, folder, counted.schema).groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def latest(spark: SparkSession, events: DataFrame, folder: str | None = None) -> DataFrame:
    """The newest event of each user; each batch brings the newest of its own, which are merged when read."""
    folder = folder or new_folder(spark)
    wanted = events.select("user_id", "ts", "event_id", "event_type")

    def write(rows: DataFrame, batch: int) -> None:
        ledger.latest(rows).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch}")

    wanted.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return ledger.latest(_parts(spark, folder, wanted.schema))
