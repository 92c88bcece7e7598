"""Verdicts over ranked scores: which family and style a list of scores means,
how far two runs have drifted apart, and how evidence is fused.

Ranked scores are arrays of ``struct<label, score>``, best first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import SEPARATOR, family_of, style_of

# Margins of the resolver.
HYBRID_MARGIN, MEDIUM_MARGIN, HYBRID_RATIO, STRONG_SECOND = 0.08, 0.20, 0.80, 0.65
# Divergence bounds of the severity ladder.
DRIFT_CRITICAL, DRIFT_LARGE, DRIFT_MODERATE, LOW_OVERLAP = 0.45, 0.20, 0.08, 0.50


def human_style(label: Column) -> Column:
    """A style's name; generic ones get their family. Which are generic, and how each is named."""
    family, leaf = F.trim(family_of(label)), F.trim(style_of(label))
    named = F.when(leaf == "Vocal", F.when(family == "Pop", F.lit("Vocal Pop")).otherwise(F.concat(family, F.lit(" Vocal"))))
    named = named.when(leaf.isin("Ballad", "Parody"), F.concat_ws(" ", family, leaf)).when(leaf == "Acoustic", F.concat(F.lit("Acoustic "), family))
    return F.when(F.contains(label, F.lit(SEPARATOR)), named.otherwise(leaf)).otherwise(leaf)


def style_confidence(margin: Column) -> Column:
    return F.when(margin >= 0.35, "high").when(margin >= 0.15, "medium").otherwise("low-medium")


def resolve(df: DataFrame, styles: str = "styles", families: str = "families") -> DataFrame:
    """Adds ``resolved, classification, confidence, family_margin, family_ratio,
    style_margin, primary_family, secondary_family, secondary_style``.

    The families decide between hybrid and primary; the best style of an eligible
    family is the candidate, the best other style of the two families its
    competitor. A competitor of the second family with the better score takes
    the candidate's place and makes the verdict hybrid.
    """
    f1, f2 = F.get(F.col(families), 0), F.get(F.col(families), 1)
    df = df.withColumns({"_f1": f1["label"], "_f2": f2["label"], "_margin": f1["score"] - F.coalesce(f2["score"], F.lit(0.0)), "_ratio": F.when(f1["score"] > 0, f2["score"] / f1["score"])})
    hybrid = F.col("_f2").isNotNull() & ((F.col("_margin") < HYBRID_MARGIN) | F.coalesce(F.col("_ratio") >= HYBRID_RATIO, F.lit(False)))
    medium = (F.col("_margin") < MEDIUM_MARGIN) | F.coalesce(F.col("_ratio") >= STRONG_SECOND, F.lit(False))
    df = df.withColumn("_hybrid", hybrid).withColumn("_sure", F.when(F.col("_hybrid"), "low-medium").when(medium, "medium").otherwise("high"))
    own = lambda s: family_of(s["label"])
    first = lambda keep: F.get(F.filter(F.col(styles), keep), 0)
    df = df.withColumn("_candidate", first(lambda s: (own(s) == F.col("_f1")) | (F.col("_hybrid") & (own(s) == F.col("_f2")))))
    in_two = lambda s: (own(s) == F.col("_f1")) | F.coalesce(own(s) == F.col("_f2"), F.lit(False))
    df = df.withColumn("_rival", first(lambda s: in_two(s) & F.coalesce(s["label"] != F.col("_candidate")["label"], F.lit(True))))
    swap = F.coalesce((F.col("_rival")["score"] > F.col("_candidate")["score"]) & (own(F.col("_rival")) == F.col("_f2")), F.lit(False))
    df = df.withColumn("_swap", swap)
    best, other = F.when(F.col("_swap"), F.col("_rival")).otherwise(F.col("_candidate")), F.when(F.col("_swap"), F.col("_candidate")).otherwise(F.col("_rival"))
    df = df.withColumns({"_best": best, "_other": other, "_hybrid": F.col("_hybrid") | F.col("_swap"), "_sure": F.when(F.col("_swap"), "low-medium").otherwise(F.col("_sure"))})
    margin = F.when(F.col("_best").isNotNull(), F.when(F.col("_other").isNull(), 1.0).when(F.col("_best")["score"] > 0, (F.col("_best")["score"] - F.col("_other")["score"]) / F.col("_best")["score"]))
    df = df.withColumn("_style_margin", margin)
    sure = style_confidence(F.col("_style_margin"))
    known = F.col("_f1").isNotNull()
    confidence = F.when(~known | F.col("_hybrid"), F.when(known, "low-medium").otherwise("low")).when(F.col("_sure") == "high", F.when(sure == "high", "high").otherwise("medium")).otherwise(F.when(sure == "low-medium", "low-medium").otherwise("medium"))
    out = {
        "resolved": F.when(known, F.coalesce(human_style(F.col("_best")["label"]), F.col("_f1"))),
        "classification": F.when(~known, "unknown").when(F.col("_hybrid"), "hybrid").otherwise("primary"),
        "confidence": confidence,
        "family_margin": F.round("_margin", 6),
        "family_ratio": F.round("_ratio", 6),
        "style_margin": F.round("_style_margin", 6),
        "primary_family": F.col("_f1"),
        "secondary_family": F.col("_f2"),
        "secondary_style": human_style(F.col("_other")["label"]),
    }
    df = df.withColumns(out)
    return df.drop(*[c for c in df.columns if c in ("_f1", "_f2", "_margin", "_ratio", "_hybrid", "_sure", "_candidate", "_rival", "_swap", "_best", "_other", "_style_margin")])


def severity(*, broad_match: Column, both_high: Column, js: Column, class_match: Column, tempo: Column, resolved_match: Column, key_match: Column, overlap: Column) -> tuple[Column, Column]:
    """Severity and reason of a drift; the first rule that applies decides."""
    rules = [
        (~broad_match & both_high, "CRITICAL", "both verdicts are sure and name different families"),
        (js >= DRIFT_CRITICAL, "CRITICAL", "family distributions lie very far apart"),
        (~broad_match, "SIGNIFICANT", "another family"),
        (~class_match, "SIGNIFICANT", "one verdict is primary, the other hybrid"),
        (js >= DRIFT_LARGE, "SIGNIFICANT", "family distributions lie far apart"),
        (tempo == "different", "SIGNIFICANT", "tempos are not equal, half or double"),
        (~resolved_match, "MINOR", "another style of the same family"),
        (js >= DRIFT_MODERATE, "MINOR", "family distributions differ somewhat"),
        (~key_match, "MINOR", "another key or mode"),
        (overlap < LOW_OVERLAP, "MINOR", "the best styles have little in common"),
    ]
    level, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for when, a, b in rules[1:]:
        level, reason = level.when(when, a), reason.when(when, b)
    return level.otherwise("STABLE"), reason.otherwise("the evidence agrees")


def convergence_level(worst: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in ("STABLE", "HIGH", "MINOR", "MEDIUM", "SIGNIFICANT", "LOW", "CRITICAL", "FAIL")])[worst]


def comparable(left_quality: Column, right_quality: Column, left_resolved: Column, right_resolved: Column) -> tuple[Column, Column]:
    """Whether two runs' verdicts can be compared, and why not."""
    short = (left_quality == "INSUFFICIENT_AUDIO") | (right_quality == "INSUFFICIENT_AUDIO")
    missing = left_resolved.isNull() | right_resolved.isNull()
    why = F.when(short, "too little audio for a verdict on one side").when(missing, "no verdict on one side").otherwise("")
    return ~F.coalesce(short, F.lit(False)) & ~missing, why


def should_recheck(mode: str, current_version: str, *, version: Column, confidence: Column, classification: Column, worst: Column) -> Column:
    """Whether a track is due: ``all``, ``old_versions`` or ``unstable``."""
    if mode == "all":
        return F.lit(True)
    if mode == "old_versions":
        return version.isNull() | (version != current_version)
    if mode == "unstable":
        return version.isNull() | ~confidence.eqNullSafe(F.lit("high")) | F.coalesce(classification == "hybrid", F.lit(False)) | F.coalesce(worst.isin("SIGNIFICANT", "CRITICAL"), F.lit(False))
    raise ValueError(f"no such recheck filter: {mode}")


def mixed_confidence(raw: Column, agreement: Column) -> Column:
    """One step lower where the sources of evidence disagree."""
    return F.when(agreement != "mixed", raw).when(raw == "high", "medium").when(raw == "medium", "low-medium").otherwise(raw)
