"""Label, text and number expressions on columns; all built-in functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "---"  # between a label's family and its style

# The order of severities, and the confidences with their scores.
SEVERITIES = ["STABLE", "MINOR", "SIGNIFICANT", "CRITICAL"]
CONFIDENCES = {"low": 0.2, "low-medium": 0.4, "medium": 0.6, "medium-high": 0.8, "high": 1.0}


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_space(x: str | Column) -> Column:
    return F.regexp_replace(F.trim(_col(x)), "\\s+", " ")


def clean_text(x: str | Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(_col(x)), F.lit(""))


def clean_list(x: str | Column) -> Column:
    """Trimmed members without empty ones; null becomes an empty list."""
    return F.coalesce(F.filter(F.transform(_col(x), lambda v: F.trim(v)), lambda v: v != ""), F.array().cast("array<string>"))


def split_values(x: str | Column) -> Column:
    """The members of a comma-separated option."""
    return clean_list(F.split(_col(x), ","))


def either(first: Column, second: Column) -> Column:
    """The first value unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def family_of(label: str | Column) -> Column:
    x = _col(label)
    return F.when(F.contains(x, F.lit(SEPARATOR)), F.split_part(x, F.lit(SEPARATOR), F.lit(1))).when(F.contains(x, F.lit(" / ")), F.split_part(x, F.lit(" / "), F.lit(1))).otherwise(x)


def style_of(label: str | Column) -> Column:
    x = _col(label)
    return F.when(F.contains(x, F.lit(SEPARATOR)), F.substring_index(x, SEPARATOR, -1)).otherwise(x)


def ordinal(x: str | Column, order: list[str]) -> Column:
    """The place of a value in an order, from 0; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), _col(x)) - 1, F.lit(-1))


def confidence_score(x: str | Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in CONFIDENCES.items() for v in pair])[F.lower(_col(x))]


def overlaps(values: str | Column, wanted: list[str]) -> Column:
    """Whether a list has any of the wanted values, whatever their case; no wanted value lets all pass."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.transform(_col(values), lambda v: F.lower(v)), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


def one_of(value: str | Column, wanted: list[str]) -> Column:
    return F.coalesce(F.lower(_col(value)).isin([w.lower() for w in wanted]), F.lit(False)) if wanted else F.lit(True)


def within(value: str | Column, least: float | None, most: float | None) -> Column:
    """Inclusive range; a null value passes only if there is no bound."""
    out = F.lit(True)
    if least is not None:
        out = out & (_col(value) >= least)
    if most is not None:
        out = out & (_col(value) <= most)
    return F.coalesce(out, F.lit(False))


def in_folder(path: str | Column, folders: list[str]) -> Column:
    """Whether a path is one of the folders or lies below one."""
    if not folders:
        return F.lit(True)
    p = F.lower(F.replace(_col(path), F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for folder in folders:
        f = folder.replace("\\", "/").rstrip("/").lower()
        out = out | (p == f) | F.startswith(p, F.lit(f + "/"))
    return F.coalesce(out, F.lit(False))


def parent_folder(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), "^(.*)/", 1)


def safe_token(x: str | Column) -> Column:
    return F.regexp_replace(_col(x), "[^\\p{L}\\p{N}._-]", "_")


def compact(x: str | Column, most: int = 512) -> Column:
    return F.left(clean_text(F.regexp_replace(_col(x), "\\s+", " ")), F.lit(most))


def text_identity(text: str | Column) -> Column:
    return F.sha2(F.trim(_col(text)), 256)


def canonical_hash(*fields: str) -> Column:
    """SHA-256 of the JSON object of the fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def optional_float(x: str | Column) -> Column:
    """A number, or null for what isn't one, such as N/A."""
    return _col(x).try_cast("double")


TEMPO_OFF, TEMPO_SHARE_OFF = 1.0, 0.025  # Fixed values: how far apart equal tempos may be, in beats a minute and as a share


def tempo_relation(left: str | Column, right: str | Column) -> Column:
    """same, half-double, different, or unknown."""
    a, b = _col(left), _col(right)
    close = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(TEMPO_OFF), TEMPO_SHARE_OFF * F.greatest(F.abs(x), F.abs(y)))
    return F.when(a.isNull() | b.isNull() | (a <= 0) | (b <= 0), "unknown").when(close(a, b), "same").when(close(a * 2, b) | close(a, b * 2), "half-double").otherwise("different")


def tempo_candidates(bpm: str | Column) -> Column:
    x = _col(bpm)
    return F.when(x > 0, F.format_string("%.2f BPM  |  half %.2f  |  2/3 %.2f  |  double %.2f", x, x / 2, x * 2 / 3, x * 2)).otherwise("n/a")


def decibels(x: str | Column) -> Column:
    """Of an amplitude, -300 at silence."""
    v = _col(x)
    return F.when(v <= 0, F.lit(-300.0)).otherwise(20 * F.log10(v))


def input_quality(seconds: str | Column) -> Column:
    """A class for a duration. 10 and 30 seconds."""
    s = _col(seconds)
    return F.when(s < 10, "INSUFFICIENT_AUDIO").when(s < 30, "SHORT_INPUT").otherwise("NORMAL")


def window_target(seconds: str | Column) -> Column:
    """How many windows a duration deserves. The bounds and the counts."""
    s = _col(seconds)
    return F.when(s < 60, 1).when(s < 120, 3).when(s < 210, 5).when(s < 300, 7).when(s < 420, 9).otherwise(11)


def needs_more_windows(classification: str | Column, confidence: str | Column) -> Column:
    return (_col(classification) == "hybrid") | (_col(confidence) != "high")


def spread(total: Column, count: Column) -> Column:
    """``count`` places spread evenly over 0 to ``total`` - 1, both ends
    included, each once; one place lies in the middle."""
    t, n = total.cast("int"), count.cast("int")
    steps = F.greatest(n, F.lit(2)) - 1
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda i: F.rint(i * (t - 1).cast("double") / steps).cast("int")))
    none = F.array().cast("array<int>")
    return F.when((t <= 0) | (n <= 0), none).when(n >= t, F.sequence(F.lit(0), F.greatest(t, F.lit(1)) - 1)).when(n == 1, F.array(F.floor(t / 2).cast("int"))).otherwise(even)


def throughput(work: str | Column, seconds: str | Column) -> Column:
    """Work per second; null where there was no time."""
    return F.when(_col(seconds) > 0, _col(work) / _col(seconds))


# How a tempo may be misread in a short loop, the beats that loops have, and the tempos looked for.
TEMPO_RATIOS, LOOP_BEATS, SLOWEST, FASTEST, LONGEST_LOOP = (0.5, 2 / 3, 1.0, 1.5, 2.0), (8, 16, 32, 64, 128), 45.0, 240.0, 30.0
BEATS_OFF, SHARE_OFF = 0.25, 0.005  # Fixed values: how far from a usual number of beats a reading may be, in beats and as a share


def loop_tempo(bpm: str | Column, seconds: str | Column) -> Column:
    """The tempo of a short loop: of the readings of a tempo the one whose beats come
    nearest to a usual number of beats, if within a quarter of a beat and half a percent
    of it, made exact; otherwise the tempo as it is."""
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(abs(r - 1)).alias("far"), F.lit(n).alias("beats")) for r in TEMPO_RATIOS for n in LOOP_BEATS])

    def reading(x: Column, p: Column) -> Column:
        tempo = x["bpm"] * p["ratio"]
        error = F.abs(x["seconds"] * tempo / 60.0 - p["beats"])
        return F.struct((error / p["beats"]).alias("share"), error.alias("error"), p["far"].alias("far"), tempo.alias("tempo"), p["beats"].alias("beats"))

    def exact(x: Column, best: Column) -> Column:
        tempo = best["beats"] * 60.0 / x["seconds"]
        usable = (x["bpm"] > 0) & (x["seconds"] > 0) & (x["seconds"] <= LONGEST_LOOP) & (best["error"] <= BEATS_OFF) & (best["share"] <= SHARE_OFF) & tempo.between(SLOWEST, FASTEST)
        return F.when(F.coalesce(usable, F.lit(False)), tempo).otherwise(x["bpm"])

    # Bound to variables, so that no part is written or computed twice.
    once = F.array(F.struct(_col(bpm).cast("double").alias("bpm"), _col(seconds).cast("double").alias("seconds")))
    best = lambda x: F.array(F.array_min(F.filter(F.transform(pairs, lambda p: reading(x, p)), lambda y: y["tempo"].between(SLOWEST, FASTEST))))
    return F.get(F.flatten(F.transform(once, lambda x: F.transform(best(x), lambda y: exact(x, y)))), 0)


def even_starts(total: str | Column, width: int, count: int) -> Column:
    """The starts of at most ``count`` windows of ``width`` spread evenly from the first to
    the last that fits, each once; a total that isn't longer has one window, to be filled up."""
    last = _col(total).cast("long") - width
    n = F.least(F.lit(count).cast("long"), last + 1)
    steps = F.greatest(n - 1, F.lit(1))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: F.floor(i * last.cast("double") / steps)))
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(places)


def path_identity(path: str | Column) -> Column:
    """What stands for the contents of a file that can't be read."""
    return F.concat(F.lit("path:"), F.sha2(_col(path), 256))


def version_triple(version: str | Column) -> Column:
    """The first three numbers of a version, before any build mark; missing ones are 0."""
    numbers = F.regexp_extract_all(F.split_part(_col(version), F.lit("+"), F.lit(1)), F.lit("(\\d+)"))
    return F.slice(F.concat(F.transform(numbers, lambda x: x.cast("int")), F.array(*[F.lit(0)] * 3)), 1, 3)


def marked_value(text: str | Column, marker: str, pattern: str = "[0-9a-fA-F]{40}") -> Column:
    """What follows a marker in a text, in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(_col(text), f"(?i){marker}\\s*({pattern})", 1)), F.lit(""))


def like_existing(old: str | Column, value: str | Column) -> Column:
    """A number written as the old text was: with its decimal mark, eight decimals, or as a whole number."""
    x = _col(value).cast("double")
    fixed = F.format_string("%.8f", x)
    whole = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(fixed)
    return F.when(F.contains(_col(old), F.lit(",")), F.replace(fixed, F.lit("."), F.lit(","))).when(F.contains(_col(old), F.lit(".")), fixed).otherwise(whole)


def memory_free(used: str | Column, total: str | Column) -> Column:
    return F.when(_col(used).isNotNull() & _col(total).isNotNull(), F.greatest(F.lit(0.0), _col(total) - _col(used)))


def memory_percent(used: str | Column, total: str | Column) -> Column:
    return F.when(_col(total) != 0, 100.0 * _col(used) / _col(total))


def source_label(kind: Column, subtype: Column, rate: Column, bits: Column, channels: Column, kbps: Column) -> Column:
    """A line on a source: format, rate, depth, channels and bit rate, as far as known."""
    khz = F.regexp_replace(F.format_string("%.3f", rate / 1000.0), "\\.?0+$", "")
    sides = F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(F.concat(channels.cast("string"), F.lit(" channels")))
    return F.concat_ws(" | ", F.concat_ws(" ", kind, subtype), F.concat(khz, F.lit(" kHz")), F.concat(F.nullif(bits, F.lit(0)).cast("string"), F.lit("-bit")), sides, F.when(kbps.isNotNull(), F.format_string("%.0f kbps", F.bround(kbps, 0))))
