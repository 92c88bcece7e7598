"""Exact percentiles of groups of any size, by histograms that are refined.

A group of up to ``small`` values is sorted in one task. Of a larger one only counts move: a
histogram over the range in which the wanted ranks lie tells the bin of each; its least and
greatest values are the next range; a round later a bin is some thousandth of that. Ranges end
when they hold one value. Each round sums its counts before it shuffles them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written

BINS = 4096


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float], *, small: int = 100_000) -> DataFrame:
    """``by, n`` and a column for each of ``shares``: percentiles of the values of each group, interpolated between neighbours.
    Nulls and NaN don't count, infinite values aren't allowed, and a group without values has no row. Null keys are a group."""
    by = list(by)
    key = F.struct(*by)
    values = written(rows.select(key.alias("key"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    groups = written(values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups")
    large = groups.filter(F.col("n") > small)
    each = values.join(large.select("key"), "key", "left_anti") if not large.isEmpty() else values
    found = each.groupBy("key").agg(F.count("*").alias("n"), *(F.percentile("v", F.lit(q)).alias(name) for name, q in shares.items()))
    if not large.isEmpty():
        found = found.union(_large(values, large, shares))
    return found.select(*(F.col(f"key.`{c}`").alias(c) for c in by), "n", *shares)


def _large(values: DataFrame, groups: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    place = F.array(*(F.lit(q) * (F.col("n") - 1) for q in shares.values()))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(F.floor(p), F.ceil(p)))))
    zero = F.lit(0).cast("long")
    wanted = written(groups.select("key", F.explode(ranks).alias("rank"), "low", "high", zero.alias("before")), "ranks")
    done = []
    while True:
        done.append(wanted.filter("low = high"))
        left = wanted.filter("low < high")
        if left.isEmpty():
            break
        ranges = left.select("key", "low", "high", "before").distinct()
        inside = values.join(ranges, "key").filter("v between low and high")
        # Halves, so that the widest ranges don't overflow.
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy("key", "low", "before", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("bin_low"), F.max("v").alias("bin_high"))
        upto = F.sum("n").over(Window.partitionBy("key", "low").orderBy("bin")) + F.col("before")
        bins = bins.select("key", "low", "bin_low", "bin_high", (upto - F.col("n")).alias("from"), upto.alias("to"))
        step = left.select("key", "rank", "low").join(bins, ["key", "low"]).filter("rank >= `from` and rank < `to`")
        wanted = written(step.select("key", "rank", F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), F.col("from").alias("before")), "ranks")
    known = done[0]
    for more in done[1:]:
        known = known.union(more)
    ranked = known.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at"))  # two ranks for each share
    out = groups.join(ranked, "key")
    for name, q in shares.items():
        p = F.lit(q) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        out = out.withColumn(name, F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return out.select("key", "n", *shares)
