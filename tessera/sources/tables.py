"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A table of few bytes in fewer partitions than there are cores, dealt evenly to
    all of them, for steps that are heavy on each row: its one file may be a single row
    group, which one task would read alone. Other tables have files and row groups
    enough and stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) >= most or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
