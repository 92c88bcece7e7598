"""Profiles: tags by group, evidence of two sources fused, and the row that a
track's evidence adds up to.

Tags, styles and families are arrays of ``struct<label, score>``, best first. All
work is on the arrays of a row, in built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import SEPARATOR
from tessera.functions.verdicts import mixed_confidence

# The labels of each group of tags, in lower case, and how many tags a group keeps.
GROUPS = {
    "genre": (
        [
            "pop music", "hip hop music", "rock music", "heavy metal", "punk rock", "grunge", "progressive rock", "rock and roll",
            "psychedelic rock", "rhythm and blues", "soul music", "reggae", "country", "swing music", "bluegrass", "funk", "folk music",
            "middle eastern music", "jazz", "disco", "classical music", "opera", "electronic music", "house music", "techno", "dubstep",
            "drum and bass", "electronica", "electronic dance music", "ambient music", "trance music", "music of latin america", "salsa music",
            "flamenco", "blues", "new-age music", "vocal music",
        ],
        8,
    ),
    "mood": (
        [
            "happy music", "funny music", "sad music", "tender music", "exciting music", "angry music", "scary music",
        ],
        5,
    ),
    "vocal": (
        [
            "singing", "choir", "chant", "mantra", "male singing", "female singing", "child singing", "synthetic singing", "rapping", "humming",
            "vocal music", "a capella",
        ],
        5,
    ),
    "instrument": (
        [
            "musical instrument", "guitar", "electric guitar", "bass guitar", "acoustic guitar", "piano", "electric piano", "keyboard (musical)",
            "organ", "electronic organ", "hammond organ", "synthesizer", "drum kit", "drum", "snare drum", "bass drum", "timpani", "tabla", "cymbal",
            "hi-hat", "wood block", "tambourine", "maraca", "gong", "tubular bells", "mallet percussion", "glockenspiel", "vibraphone", "steelpan",
            "orchestra", "brass instrument", "french horn", "trumpet", "trombone", "bowed string instrument", "string section", "cello",
            "double bass", "flute", "saxophone", "clarinet", "harp", "bell", "accordion", "harmonica", "banjo", "mandolin", "ukulele",
            "steel guitar, slide guitar", "marimba, xylophone", "violin, fiddle", "wind instrument, woodwind instrument",
        ],
        8,
    ),
    "production": (
        [
            "electronic music", "electronica", "electronic dance music", "synthesizer", "drum machine", "sampler", "distortion", "effects unit",
        ],
        5,
    ),
}
# The family of each genre tag.
TAG_FAMILIES = {
    "pop music": "Pop",
    "hip hop music": "Hip Hop",
    "rock music": "Rock",
    "heavy metal": "Rock",
    "punk rock": "Rock",
    "grunge": "Rock",
    "progressive rock": "Rock",
    "rock and roll": "Rock",
    "psychedelic rock": "Rock",
    "rhythm and blues": "Funk / Soul",
    "soul music": "Funk / Soul",
    "reggae": "Reggae",
    "country": "Folk, World, & Country",
    "bluegrass": "Folk, World, & Country",
    "funk": "Funk / Soul",
    "folk music": "Folk, World, & Country",
    "middle eastern music": "Folk, World, & Country",
    "jazz": "Jazz",
    "classical music": "Classical",
    "opera": "Classical",
    "electronic music": "Electronic",
    "house music": "Electronic",
    "techno": "Electronic",
    "dubstep": "Electronic",
    "drum and bass": "Electronic",
    "electronica": "Electronic",
    "electronic dance music": "Electronic",
    "ambient music": "Electronic",
    "trance music": "Electronic",
    "music of latin america": "Latin",
    "salsa music": "Latin",
    "flamenco": "Latin",
    "blues": "Blues",
    "vocal music": "Pop",
}
# What distributors call a family, where it isn't the family's own name.
DISTRIBUTORS = {"Hip Hop": "Hip-Hop/Rap", "Funk / Soul": "R&B/Soul", "Folk, World, & Country": "Folk/World/Country", "Stage & Screen": "Soundtrack"}
# The vocal tags that say more than that there is a voice.
SPECIFIC_VOCALS = ["male singing", "female singing", "child singing", "synthetic singing", "choir", "chant", "mantra", "rapping", "humming", "a capella"]
LEAST_SCORE = 0.03  # Fixed value: weaker tags are no evidence


def _lookup(x: Column, pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for p in pairs.items() for v in p])[x]


def tag_group(tags: Column, group: str) -> Column:
    """The first tags of a group that are strong enough, in their order."""
    labels, most = GROUPS[group]
    return F.slice(F.filter(tags, lambda t: F.lower(F.trim(t["label"])).isin(labels) & (t["score"] >= LEAST_SCORE)), 1, most)


def tag_family(label: Column) -> Column:
    return _lookup(F.lower(label), TAG_FAMILIES)


def leaf_of(label: Column) -> Column:
    """The style without its family, which ends at the first separator."""
    return F.trim(F.regexp_replace(label, f"^.*?{SEPARATOR}", ""))


def stated_family(label: Column) -> Column:
    """The family that a label states; null if it states none."""
    return F.when(F.contains(label, F.lit(SEPARATOR)), F.trim(F.split_part(label, F.lit(SEPARATOR), F.lit(1))))


def is_alias(label: Column, style: Column) -> Column:
    """Whether a label names a resolved style: by its leaf, or with its family before or after it."""
    family, leaf = stated_family(label), leaf_of(label)
    return F.lower(F.trim(style)).isin(F.lower(leaf), F.lower(F.concat(family, F.lit(" "), leaf)), F.lower(F.concat(leaf, F.lit(" "), family)))


def first_where(items: Column, keep) -> Column:
    return F.get(F.filter(items, lambda x: F.coalesce(keep(x), F.lit(False))), 0)


def resolved_family(styles: Column, style: Column) -> Column:
    """The family of the first style that a resolved style names."""
    return stated_family(first_where(styles, lambda s: is_alias(s["label"], style))["label"])


def unique_labels(items: Column, most: int, skip: Sequence[str] = ()) -> Column:
    """The first labels that differ in more than case and aren't to be skipped, in order."""
    names = F.transform(items, lambda x: F.trim(x["label"]))
    first = F.filter(names, lambda x, i: ~F.exists(F.slice(names, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(F.filter(first, lambda x: ~F.lower(x).isin([s.lower() for s in skip])) if skip else first, 1, most)


def adjacent_labels(styles: Column, blocked: Sequence[Column], most: int = 4) -> Column:
    """The leaves of the best styles but for the blocked ones."""
    leaves = F.array_distinct(F.transform(styles, lambda s: leaf_of(s["label"])))
    open_ = lambda x: ~F.coalesce(F.lower(x).isin(*[F.lower(b) for b in blocked]), F.lit(False))
    return F.slice(F.filter(leaves, open_), 1, most)


def vocal_summary(vocals: Column) -> Column:
    """The first specific tag, else the first."""
    return F.coalesce(first_where(vocals, lambda t: F.lower(t["label"]).isin(SPECIFIC_VOCALS))["label"], F.get(vocals, 0)["label"])


def distributor(family: Column) -> Column:
    return F.coalesce(_lookup(family, DISTRIBUTORS), family)


def tag_families(genres: Column) -> Column:
    """The families of genre tags with the sum of their scores, greatest first."""
    known = F.filter(F.transform(genres, lambda t: F.struct(tag_family(t["label"]).alias("label"), F.greatest(t["score"], F.lit(0.0)).alias("score"))), lambda t: t["label"].isNotNull())
    names = F.array_distinct(F.transform(known, lambda t: t["label"]))
    total = lambda name: F.aggregate(F.filter(known, lambda t: t["label"] == name), F.lit(0.0), lambda a, t: a + t["score"])
    return best_first(F.transform(names, lambda n: F.struct(n.alias("label"), total(n).alias("score"))))


def best_first(items: Column) -> Column:
    """By score, greatest first; ties by label."""
    keyed = F.array_sort(F.transform(items, lambda x: F.struct((-x["score"]).alias("by"), x["label"].alias("label"), x["score"].alias("score"))))
    return F.transform(keyed, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))


def total_of(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.greatest(x["score"], F.lit(0.0)))


def score_of(items: Column, label: Column) -> Column:
    return F.aggregate(F.filter(items, lambda x: x["label"] == label), F.lit(0.0), lambda a, x: a + F.greatest(x["score"], F.lit(0.0)))


def with_families(df: DataFrame, families: str = "families", genres: str = "genre_tags", base_weight: float = 0.75) -> DataFrame:
    """Adds ``evidence``, the families of both sources as one distribution, and
    ``agreement``: maest_only without tags of a known family, else agree or mixed by
    the best of each. The tags' part grows with their strength, up to ``1 - base_weight``."""
    df = df.withColumn("_tags", tag_families(F.col(genres)))
    df = df.withColumns({"_base_total": total_of(F.col(families)), "_tags_total": total_of(F.col("_tags"))})
    weight = (1 - base_weight) * F.least(F.lit(1.0), F.col("_tags_total"))
    share = lambda label: F.when(F.col("_base_total") > 0, score_of(F.col(families), label) / F.col("_base_total")).otherwise(0.0)
    extra = lambda label: F.round(score_of(F.col("_tags"), label) / F.col("_tags_total"), 6)
    names = F.array_distinct(F.concat(F.transform(families, lambda x: x["label"]), F.transform("_tags", lambda x: x["label"])))
    both = best_first(F.transform(names, lambda n: F.struct(n.alias("label"), ((1 - weight) * share(n) + weight * extra(n)).alias("score"))))
    alone = F.when(F.col("_base_total") > 0, F.transform(families, lambda x: F.struct(x["label"].alias("label"), share(x["label"]).alias("score")))).otherwise(F.filter(both, lambda x: F.lit(False)))
    rounded = lambda items: F.transform(items, lambda x: F.struct(x["label"].alias("label"), F.round(x["score"], 6).alias("score")))
    some = F.col("_tags_total") > 0
    top = F.get(F.col(families), 0)["label"].eqNullSafe(F.get(F.col("_tags"), 0)["label"])
    out = {"evidence": F.when(some, rounded(both)).otherwise(rounded(alone)), "agreement": F.when(~some, "maest_only").when(top, "agree").otherwise("mixed")}
    return df.withColumns(out).drop("_tags", "_base_total", "_tags_total")


def prompt(primary: Column, secondary: Column, moods: Column, vocal: Column, instruments: Column, bpm: Column, key: Column, mode: Column) -> Column:
    """A line that describes the style; null without a primary style."""
    influence = F.when((secondary != "") & (F.lower(secondary) != F.lower(primary)), F.concat(secondary, F.lit(" influence")))
    tempo = F.when(bpm != 0, F.format_string("%.0f BPM", F.bround(bpm, 0)))
    tone = F.when(key != "", F.concat_ws(" ", key, F.nullif(mode, F.lit(""))))
    return F.when(primary.isNotNull(), F.concat_ws(", ", primary, influence, F.slice(moods, 1, 2), F.nullif(vocal, F.lit("")), F.slice(instruments, 1, 3), tempo, tone))


def assemble(df: DataFrame) -> DataFrame:
    """Adds the profile to rows with ``styles, families, resolved, confidence,
    primary_family, secondary_family, secondary_style, tags, bpm, key, mode``.

    Fused evidence decides the family unless the verdict is sure; a resolved style
    of another family gives way to the best style of that family, and where there
    is none the family gives way. What gave way is the secondary influence.
    """
    df = df.withColumns({f"{g}_tags": tag_group(F.col("tags"), g) for g in GROUPS})
    df = with_families(df)
    df = df.withColumn("_wanted", F.when((F.size("evidence") > 0) & ~F.col("confidence").eqNullSafe(F.lit("high")), F.get("evidence", 0)["label"]).otherwise(F.col("primary_family")))
    df = df.withColumn("_stated", resolved_family(F.col("styles"), F.col("resolved")))
    df = df.withColumn("_best", first_where(F.col("styles"), lambda s: stated_family(s["label"]) == F.col("_wanted"))["label"])
    clash = F.coalesce(F.col("_wanted") != F.col("_stated"), F.lit(False))
    moved = F.col("_wanted").isNotNull() & ~F.col("_wanted").eqNullSafe(F.col("primary_family"))
    family = F.when(clash & F.col("_best").isNull(), F.col("_stated")).otherwise(F.col("_wanted"))
    df = df.withColumns({"broad_family": family, "primary_style": F.when((clash | moved) & F.col("_best").isNotNull(), leaf_of(F.col("_best"))).otherwise(F.col("resolved"))})
    replaced = F.col("resolved").isNotNull() & (F.col("resolved") != "") & ~F.col("primary_style").eqNullSafe(F.col("resolved"))
    other_family = ~F.col("broad_family").eqNullSafe(F.col("primary_family")) & (F.col("resolved") != "")
    secondary = F.when(replaced | F.coalesce(other_family, F.lit(False)), F.col("resolved")).otherwise(F.coalesce(F.nullif("secondary_style", F.lit("")), F.col("secondary_family")))
    df = df.withColumn("secondary", secondary)
    df = df.withColumns(
        {
            "adjacent": adjacent_labels(F.col("styles"), [F.col("primary_style"), F.col("secondary")]),
            "moods": unique_labels(F.col("mood_tags"), 3),
            "vocal": vocal_summary(F.col("vocal_tags")),
            "instruments": unique_labels(F.col("instrument_tags"), 4, ["Musical instrument"]),
            "production": unique_labels(F.col("production_tags"), 3),
            "profile_confidence": mixed_confidence(F.col("confidence"), F.col("agreement")),
            "distributor_genre": distributor(F.col("broad_family")),
            "distributor_subgenre": F.when(~F.col("primary_style").eqNullSafe(F.col("broad_family")), F.nullif("primary_style", F.lit(""))),
        }
    )
    df = df.withColumn("style_prompt", prompt(*[F.col(c) for c in ("primary_style", "secondary", "moods", "vocal", "instruments", "bpm", "key", "mode")]))
    return df.drop("_wanted", "_stated", "_best")
