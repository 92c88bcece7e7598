"""Latest rows, pairs of runs and coverage between versions.

"Latest" is by time, then by ingest sequence: tables carry a sequence number
because rows have no order of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1, rank: str = "rn") -> DataFrame:
    """The ``n`` last rows of each key by ``order``, with their rank. The planner
    limits each group before it shuffles, so a hot key costs ``n`` rows a task."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_by_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last row of each key by a combining aggregate, for wide fan-in on few keys."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def with_latest(dimension: DataFrame, runs: DataFrame, key: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every dimension row with its latest run; those without one stay."""
    return dimension.join(latest(runs, keys, order).drop("rn"), key, "left")


def pairs_of(runs: DataFrame, key: str, side: str, left: str, right: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each key the latest run of side ``left`` beside that of ``right``.

    One aggregation over both sides, rather than a join of two scans."""
    both = runs.filter(F.col(side).isin(left, right))
    pick = lambda which, name: F.max_by(F.struct(*values), F.when(F.col(side) == which, F.struct(*order))).alias(name)
    return both.groupBy(key).agg(pick(left, "l"), pick(right, "r"), F.count_if(F.col(side) == left).alias("_nl"), F.count_if(F.col(side) == right).alias("_nr")).filter("_nl > 0 AND _nr > 0").drop("_nl", "_nr")


def coverage(runs: DataFrame, key: str, side: str, left: str, right: str) -> DataFrame:
    """How many keys each side has, both have, and one has alone."""
    flags = runs.filter(F.col(side).isin(left, right)).groupBy(key).agg(F.bool_or(F.col(side) == left).alias("l"), F.bool_or(F.col(side) == right).alias("r"))
    return flags.agg(
        F.count_if("l").alias("left_total"),
        F.count_if("r").alias("right_total"),
        F.count_if(F.col("l") & F.col("r")).alias("common"),
        F.count_if(F.col("l") & ~F.col("r")).alias("left_only"),
        F.count_if(F.col("r") & ~F.col("l")).alias("right_only"),
    )


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after changes: for each key the row that is last by ``order``."""
    return latest(current.unionByName(changes, allowMissingColumns=True), keys, order).drop("rn")


def scoped(runs: DataFrame, where: Column, key: str, order: Sequence[str], duplicates: str = "error") -> DataFrame:
    """The runs of one scope, one a key: ``error`` refuses a key with several, ``latest`` keeps the last."""
    if duplicates not in ("error", "latest"):
        raise ValueError(f"no such duplicate policy: {duplicates}")
    own = runs.filter(where)
    if duplicates == "error":
        several = own.groupBy(key).count().filter("count > 1").select(key).orderBy(key).limit(5).collect()
        if several:
            raise ValueError(f"several runs in scope for {[r[0] for r in several]}")
        return own
    return latest(own, [key], order).drop("rn")
