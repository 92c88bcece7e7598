"""Writing runs into a history of tables: tracks, file locations, runs and their scores.

Each function gives the tables after the change. A write of many results is one
job for each table, whatever their number; a result that is written again
replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.latest import latest

PART_BYTES, MOST_PARTS = 2 << 20, 10_000  # of the planner's estimate for a table, that a task gets


def identified(files: DataFrame, locations: DataFrame, content: str = "content") -> DataFrame:
    """``path, size_bytes, modified, track_id, hashed``: files whose path, size and
    time are known keep their track, and only the contents of the others are hashed."""
    known = locations.select("path", "size_bytes", "modified", F.col("track_id").alias("_known"))
    found = files.join(known, ["path", "size_bytes", "modified"], "left")
    fresh = F.col("_known").isNull()
    track = F.when(fresh, F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256))).otherwise(F.col("_known"))
    return found.select("path", "size_bytes", "modified", track.alias("track_id"), fresh.alias("hashed"))


def seen_locations(locations: DataFrame, files: DataFrame) -> DataFrame:
    """Locations by path, the last seen of each (``path, track_id, size_bytes, modified, seen_at``)."""
    return latest(locations.unionByName(files), ["path"], ["seen_at", "track_id"]).drop("rn")


def seen_tracks(tracks: DataFrame, seen: DataFrame) -> DataFrame:
    """Tracks after some were seen: the first time stays, the last one, its path
    and the last known size are the new ones. ``seen`` has ``track_id, seen_at, path, size_bytes``."""
    old = tracks.select("track_id", "first_seen", "last_seen", "last_path", "size_bytes")
    new = seen.select("track_id", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.col("path").alias("last_path"), "size_bytes")
    last = F.struct("last_seen", "last_path")
    return old.unionByName(new).groupBy("track_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("last_path", last).alias("last_path"), F.max_by("size_bytes", F.when(F.col("size_bytes").isNotNull(), last)).alias("size_bytes")
    )


def written_runs(runs: DataFrame, results: DataFrame, order: str = "seq") -> DataFrame:
    """Runs by id: a result whose run is there replaces it."""
    return latest(runs.unionByName(results, allowMissingColumns=True), ["run_id"], [order]).drop("rn")


def written_scores(scores: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """``run_id, rank, label, score``: the scores of results' runs are replaced as a whole by
    those of their array ``column``, ranked in its order; other runs keep theirs."""
    kept = scores.join(results.select("run_id").distinct(), "run_id", "left_anti")
    new = results.select("run_id", F.posexplode(column).alias("_i", "_x"))
    return kept.unionByName(new.select("run_id", (F.col("_i") + 1).alias("rank"), "_x.label", "_x.score"))


def _by_id(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "comparison_id")


def stored_comparisons(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """The log of comparisons with new ones, by the digest of what was compared: one that is there isn't added again. Rows are dealt by
    digest to parts whose number grows with the input, so a task's share doesn't."""
    keyed = pairs.withColumn("comparison_id", F.sha2(F.concat_ws("|", "track_id", "left_run", "right_run", "kind"), 256))
    size = sum(int(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for x in (log, keyed))
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))
    held = _by_id(log, parts)
    return held.unionByName(_by_id(keyed, parts).join(_by_id(log.select("comparison_id"), parts), "comparison_id", "left_anti").dropDuplicates(["comparison_id"]))
