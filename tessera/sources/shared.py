"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a temporary folder; a cluster must name one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or getattr(shared_dir, "own", None)
    if found is None:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps don't
    compute it again, lost executors lose nothing, and its size is known to
    the planner, which then broadcasts it only below its own threshold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
