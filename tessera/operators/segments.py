"""Plans of time segments over media of known durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import spread


def plan_segments(media: DataFrame, duration: str, *, window: float = 30.0, hop: float = 30.0, least: float = 1.0, most: int = 64) -> DataFrame:
    """Adds ``segment, start_s, end_s, is_short``: windows of ``window`` seconds
    every ``hop``; a last one under ``least`` seconds is dropped, and of more than
    ``most`` an even spread is kept. Media too short have no row."""
    d = F.col(duration).cast("double")
    # Windows with start < duration and at least `least` seconds long: their starts are a prefix.
    count = F.when(d >= least, F.least(F.ceil(d / hop), F.floor((d - least) / hop) + 1)).otherwise(0).cast("int")
    chosen = spread(count, F.least(count, F.lit(most)))
    rows = media.filter(d.isNotNull() & ~F.isnan(d)).withColumn("_chosen", chosen)
    rows = rows.select("*", F.posexplode("_chosen").alias("segment", "_i")).drop("_chosen")
    start = F.round(F.col("_i") * hop, 6)
    end = F.round(F.least(F.col("_i") * hop + window, d), 6)
    return rows.withColumns({"start_s": start, "end_s": end}).withColumn("is_short", F.col("end_s") - F.col("start_s") < window).drop("_i")
