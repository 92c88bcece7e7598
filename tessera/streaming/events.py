"""Structured Streaming over event logs: windows, duplicates, latest states and
idempotent sinks. Each function takes a stream or a table of events and returns
the same kind."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tessera.sources.shared import shared_dir


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files. Times without a zone are taken as UTC, as
    watermarks need zoned ones; set the session's zone to UTC."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of text files of one JSON object a line; broken lines are kept in ``broken``."""
    lines = spark.readStream.text(path)
    return lines.select("value", F.from_json("value", schema).alias("e")).select("e.*", F.when(F.col("e").isNull(), F.col("value")).alias("broken"))


def windows(events: DataFrame, by: Sequence[str], *, size: str, hop: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling or hopping windows of event time."""
    window = F.window("ts", size, hop) if hop else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, by: Sequence[str], *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def once(events: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Events by key once, as long as repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def latest_state(events: DataFrame, by: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last values of each key; later changes of a key replace it, in update or complete mode."""
    return events.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("s")).select(*by, "s.*")


def keyed_sink(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Appends rows whose keys the table lacks. A batch that runs again, after a
    failure, adds nothing: its rows are there, or its folder is replaced."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(list(keys))
        if _exists(spark, path):
            # What this very batch wrote in an attempt that failed later doesn't count, and isn't read: its folder is replaced.
            done = spark.read.schema(StructType([*batch.schema.fields, StructField("epoch", LongType())])).parquet(path).filter(F.col("epoch") != epoch)
            new = new.join(done.select(*keys), list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now, as a table: its batches are written to
    the shared folder, in complete mode the last one alone."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    out = f"{folder}/{name}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
