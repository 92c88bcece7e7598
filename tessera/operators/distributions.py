"""Label distributions: reduction of window scores, shares, and drift between two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduce_windows(scores: DataFrame, unit: Sequence[str], window: str, label: str = "label", score: str = "score", position: str = "pos", top: int | None = 15) -> DataFrame:
    """``unit, label, score, rank``: the mean score of each label over *all*
    windows of a unit, absent labels counting as 0. A label that repeats in a
    window counts once, by its first position (of equal ones, the least score). Ties in score go by label."""
    first = scores.groupBy(*unit, window, label).agg(F.min_by(score, F.struct(position, score)).alias("_s"))
    windows = scores.groupBy(*unit).agg(F.count_distinct(window).alias("_n"))
    sums = first.groupBy(*unit, label).agg(F.sum(F.greatest(F.col("_s"), F.lit(0.0))).alias("_sum"))
    out = sums.join(windows, list(unit)).select(*unit, label, (F.col("_sum") / F.col("_n")).alias(score))
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy(F.col(score).desc(), label))
    out = out.withColumn("rank", rank)
    return out if top is None else out.filter(F.col("rank") <= top)


def shares(df: DataFrame, unit: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Each value's share of its unit's total; 0 where the total is."""
    total = F.sum(value).over(Window.partitionBy(*unit))
    return df.withColumn(out, F.when(total > 0, F.col(value) / total).otherwise(0.0))


def drift(left: DataFrame, right: DataFrame, unit: Sequence[str], label: str = "label", share: str = "share") -> DataFrame:
    """``unit, cosine, js``: cosine and Jensen-Shannon divergence (base 2) of two
    distributions by unit. Two empty ones are alike; an empty one and another
    have cosine 0."""
    a = left.select(*unit, label, F.col(share).alias("_a"))
    b = right.select(*unit, label, F.col(share).alias("_b"))
    both = a.join(b, [*unit, label], "full").fillna(0.0, ["_a", "_b"])
    mid = (F.col("_a") + F.col("_b")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / mid)).otherwise(0.0)
    sums = both.groupBy(*unit).agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"), F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_b") * F.col("_b")).alias("_bb"), F.sum(part("_a")).alias("_ka"), F.sum(part("_b")).alias("_kb"))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    cosine = F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), clamp(F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))).when((F.col("_aa") == 0) & (F.col("_bb") == 0), 1.0).otherwise(0.0)
    return sums.select(*unit, cosine.alias("cosine"), clamp((F.col("_ka") + F.col("_kb")) / 2 / F.ln(F.lit(2.0))).alias("js"))


def rank_overlap(left: DataFrame, right: DataFrame, unit: Sequence[str], label: str = "label", rank: str = "rank", top: int = 10) -> DataFrame:
    """``unit, overlap``: common mass of the two top lists, labels weighing 1 / rank."""

    def weights(df: DataFrame, name: str) -> DataFrame:
        return shares(df.filter(F.col(rank) <= top).withColumn("_w", 1.0 / F.col(rank)), unit, "_w", name).select(*unit, label, name)

    both = weights(left, "_a").join(weights(right, "_b"), [*unit, label], "full").fillna(0.0, ["_a", "_b"])
    return both.groupBy(*unit).agg(F.sum(F.least("_a", "_b")).alias("overlap"))


def fuse(base: DataFrame, extra: DataFrame, unit: Sequence[str], label: str = "label", base_weight: float = 0.75) -> DataFrame:
    """``unit, label, score``: two sources of family scores as one distribution.
    The second source weighs up to ``1 - base_weight``, by its strength (its
    total, 1 at most); without it the first stands alone."""
    left = shares(base, unit, "score", "_a").select(*unit, label, "_a")
    right = shares(extra, unit, "score", "_b").select(*unit, label, "_b", "score")
    strength = extra.groupBy(*unit).agg(((1 - base_weight) * F.least(F.lit(1.0), F.sum("score"))).alias("_w"))
    both = left.join(right.drop("score"), [*unit, label], "full").fillna(0.0, ["_a", "_b"]).join(strength, list(unit), "left").fillna(0.0, ["_w"])
    return both.select(*unit, label, ((1 - F.col("_w")) * F.col("_a") + F.col("_w") * F.col("_b")).alias("score"))
