"""Coverage, staleness, integrity and differences between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(catalog: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Catalog rows without an index row."""
    return catalog.join(index.select(key).distinct(), key, "left_anti")


def stale(index: DataFrame, catalog: DataFrame, key: str, current: Column) -> DataFrame:
    """Index *rows* of other builds whose key is in the catalog."""
    return index.filter(~current).join(catalog.select(key).distinct(), key, "left_semi")


def status(catalog: DataFrame, index: DataFrame, key: str, current: Column) -> DataFrame:
    """One row: catalog keys, keys with a current and with a stale index row, coverage."""
    marks = index.groupBy(key).agg(F.bool_or(current).alias("_current"), F.count_if(~current).alias("_stale"))
    joined = catalog.select(key).distinct().join(marks, key, "left")
    return joined.agg(
        F.count("*").alias("catalog_rows"),
        F.count_if("_current").alias("current_rows"),
        F.coalesce(F.sum("_stale"), F.lit(0)).alias("stale_rows"),
        F.when(F.count("*") > 0, F.count_if("_current") / F.count("*")).otherwise(0.0).alias("coverage"),
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent isn't there."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def differences(base: DataFrame, candidate: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, base, candidate, change`` where the values of two snapshots differ, null-safely."""
    a, b = base.select(*keys, F.col(value).alias("base"), F.lit(True).alias("_a")), candidate.select(*keys, F.col(value).alias("candidate"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full").filter(~(F.col("base").eqNullSafe(F.col("candidate")) & F.col("_a").eqNullSafe(F.col("_b"))))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "base", "candidate", change.alias("change"))


def patched(base: DataFrame, patch: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``base`` with the patch's values on existing keys; keys that the patch has twice, or alone, change nothing."""
    once = patch.groupBy(*keys).agg(F.max(value).alias("_new"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return base.join(once, list(keys), "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def corrupt(vectors: DataFrame, blob: str, digest: str, dimension: int) -> DataFrame:
    """Rows whose little-endian float blob has another digest or length."""
    return vectors.filter((F.sha2(blob, 256) != F.col(digest)) | (F.length(blob) != 4 * dimension))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """``rows, digest``: equal for two tables with the same rows in any order;
    combines on every task, so nothing is sorted or gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(F.count("*").alias("rows"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)]), 256).alias("digest"))


def unlinked(nodes: DataFrame, edges: DataFrame, key: str, source: str = "src", target: str = "dst") -> DataFrame:
    """The nodes that no edge leaves or reaches."""
    ends = edges.select(F.explode(F.array(source, target)).alias(key)).distinct()
    return nodes.join(ends, key, "left_anti")


def dangling(choices: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The choices whose row isn't there."""
    return choices.join(rows.select(key).distinct(), key, "left_anti")
