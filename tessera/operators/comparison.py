"""A candidate's audio against a reference's: lag, shift, gain, residual, attacks and mono loss, a row for each pair.

Both sides are frames with the same ``path`` for a pair. Only a pair's envelope, a value for each millisecond, is
looked at as a whole; all else is joins of frames and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters, rhythm, signal
from tessera.operators.rhythm import ATTACK_FAIL, ATTACK_WARN
from tessera.sources.shared import written

# The bounds in dB of what mono sums may lose, the attack and the sustain around an event in s, and how much earlier than its score's peak an event is.
MONO_WARN, MONO_FAIL = -0.5, -1.5
ATTACK, SUSTAIN, EARLIER = (-0.005, 0.035), (0.045, 0.145), 0.004


def verdict(value: Column, warn: float, fail: float, missing: str) -> Column:
    return F.when(value.isNull(), missing).when(value < fail, "FAIL").when(value < warn, "WARN").otherwise("PASS")


def lags(reference: DataFrame, candidate: DataFrame, max_lag_s: float = 2.0) -> DataFrame:
    """``path, lag_samples, lag_ms, correlation``: how much later the candidate is, by the envelopes of a millisecond, smoothed over 20."""
    smooth = lambda f: rhythm.moving_average(rhythm.steps(f), 20)
    rates = reference.groupBy("path").agg(F.first("rate").alias("rate"))
    found = rhythm.best_lag(smooth(reference), smooth(candidate), round(1000 * max_lag_s)).join(rates, "path")
    lag = F.round(F.col("lag") * F.col("rate") / 1000).cast("long")
    return found.select("path", lag.alias("lag_samples"), (1000 * lag / F.col("rate")).alias("lag_ms"), "correlation")


def aligned(reference: DataFrame, candidate: DataFrame, size: int, lag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What both have in common once the candidate is moved by its lag, sample by sample, as frames of ``size``. A pair without
    common samples has no rows."""
    first, other = F.greatest(-F.col("lag_samples"), F.lit(0)), F.greatest(F.col("lag_samples"), F.lit(0))
    a, b = filters.samples(reference), filters.samples(candidate).withColumnRenamed("samples", "others")
    spans = lag.join(a, "path").join(b, "path").withColumn("count", F.least(F.col("samples") - first, F.col("others") - other)).filter("count > 0")
    spans = written(spans.select("path", first.alias("first"), other.alias("other"), "count"), "spans")
    moved = lambda framed, start: filters.shifted(framed, size, spans.select("path", F.col(start).alias("start"), "count"))
    return moved(reference, "first"), moved(candidate, "other")


def scaled(framed: DataFrame, gains: DataFrame) -> DataFrame:
    by = lambda c: F.transform(c, lambda x: (x * F.col("gain")).cast("float")).alias(c)
    return framed.join(gains.select("path", "gain"), "path").select("path", "rate", "channels", "frame", by("left"), by("right"))


def events(framed: DataFrame, most: int = 64) -> DataFrame:
    """``path, w, sample, detected``: the strongest attacks of the band-passed audio in the order of time."""
    found = rhythm.transients(rhythm.steps(filters.filtered(framed)), most=most)
    rates = framed.groupBy("path").agg(F.first("rate").alias("rate"))
    sample = F.greatest(F.round(F.col("t") * F.col("rate") / 1000 - EARLIER * F.col("rate")).cast("long"), F.lit(0))
    return found.join(rates, "path").select("path", F.col("t").alias("w"), sample.alias("sample"), "rate", "detected")


def _square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def attack_measures(framed: DataFrame, size: int, event: DataFrame) -> DataFrame:
    """``path, w, peak_db, rms_db, sustain_db`` of both sides around each event that has all its samples."""
    at = lambda s: F.floor(F.abs(F.lit(s)) * F.col("rate")) * (1 if s >= 0 else -1)
    start, length = F.col("sample") + at(ATTACK[0]), at(SUSTAIN[1]) - at(ATTACK[0])
    cut = filters.windows_of(framed, size, event.select("path", "w", start.alias("start"), length.alias("length")))
    whole = cut.filter(F.size("left") == length)
    part = lambda c, a, b: F.slice(c, (at(a) - at(ATTACK[0]) + 1).cast("int"), (at(b) - at(a)).cast("int"))
    peak = F.greatest(*(F.array_max(F.transform(part(c, *ATTACK), F.abs)) for c in ("left", "right"))).cast("double")
    level = lambda span: F.sqrt((_square(part("left", *span)) + _square(part("right", *span))) / (2 * F.size(part("left", *span))))
    db = lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-15)))
    return whole.select("path", "w", db(peak).alias("peak_db"), db(level(ATTACK)).alias("rms_db"), db(level(SUSTAIN)).alias("sustain_db"))


def attack_deltas(reference: DataFrame, candidate: DataFrame, size: int, event: DataFrame) -> DataFrame:
    """``path, w, peak_delta, rms_delta, contrast_delta`` for each event, the candidate less the reference."""
    a, b = (attack_measures(f, size, event).alias(s) for f, s in ((reference, "a"), (candidate, "b")))
    delta = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    return a.join(b, ["path", "w"]).select("path", "w", delta("peak_db").alias("peak_delta"), delta("rms_db").alias("rms_delta"), (delta("peak_db") - delta("sustain_db")).alias("contrast_delta"))


def retention(deltas: DataFrame) -> DataFrame:
    """``path, events_used, rms_delta, contrast_delta, guard``: medians over a file's events, and the worse of them."""
    middle = lambda c: F.percentile(c, F.lit(0.5))  # noqa: E731  of 64 events at most
    out = deltas.groupBy("path").agg(F.count("*").alias("events_used"), middle("rms_delta").alias("rms_delta"), middle("contrast_delta").alias("contrast_delta"))
    return out.withColumn("guard", F.least("rms_delta", "contrast_delta"))


def mono_deltas(reference: DataFrame, candidate: DataFrame, size: int) -> DataFrame:
    """``path, scope, reference_db, candidate_db, delta`` of the mono sum's retention: overall, and by band, where both have two channels."""

    def of(framed: DataFrame) -> DataFrame:
        two = framed.filter("channels >= 2")
        overall = signal.levels(two).select("path", F.lit("overall").alias("scope"), F.col("mono_retention_db").alias("db"))
        return overall.union(filters.welch_retention(two, size).select("path", F.col("band").alias("scope"), F.col("retention_db").alias("db")))

    a, b = of(reference).withColumnRenamed("db", "reference_db"), of(candidate).withColumnRenamed("db", "candidate_db")
    return a.join(b, ["path", "scope"]).withColumn("delta", F.col("candidate_db") - F.col("reference_db")).filter("delta is not null")


def residual(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """``path, residual_db``: the power of the difference against the reference's, of aligned frames."""
    other = candidate.select("path", "frame", F.col("left").alias("l"), F.col("right").alias("r"))
    less = lambda a, b: _square(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
    sums = reference.join(other, ["path", "frame"]).groupBy("path").agg(F.sum(less("left", "l") + less("right", "r")).alias("d"), F.sum(_square(F.col("left")) + _square(F.col("right"))).alias("p"))
    return sums.select("path", F.when(F.col("p") > 0, 10 * F.log10(F.greatest(F.col("d") / F.col("p"), F.lit(1e-30)))).alias("residual_db"))


def compared(reference: DataFrame, candidate: DataFrame, size: int, *, max_lag_s: float = 2.0, max_events: int = 64) -> DataFrame:
    """A row for each pair of common samples: lag, gain, residual, attacks, mono loss, and the worst status. Frames have ``size``
    samples, and both sides one rate (see ``rhythm.resampled``)."""
    lag = written(lags(reference, candidate, max_lag_s), "lags")
    a, b = (written(f, "aligned") for f in aligned(reference, candidate, size, lag))
    gains = written(rhythm.level_gain(rhythm.steps(a), rhythm.steps(b)), "gains")
    b = written(scaled(b, gains), "scaled")
    event = written(events(a, max_events), "events")
    attacks = retention(attack_deltas(a, b, size, event))
    scopes = mono_deltas(a, b, size).groupBy("path").agg(F.min_by("scope", F.struct("delta", "scope")).alias("worst_scope"), F.min("delta").alias("worst_delta"))
    out = lag.join(gains, "path").join(residual(a, b), "path", "left").join(event.groupBy("path").agg(F.first("detected").alias("events_detected")), "path", "left")
    out = out.join(attacks, "path", "left").join(scopes, "path", "left")
    attack_status, mono_status = verdict(F.col("guard"), ATTACK_WARN, ATTACK_FAIL, "FAIL"), verdict(F.col("worst_delta"), MONO_WARN, MONO_FAIL, "NOT_APPLICABLE")
    worst = F.when((F.col("attack_status") == "FAIL") | (F.col("mono_status") == "FAIL"), "FAIL").when((F.col("attack_status") == "WARN") | (F.col("mono_status") == "WARN"), "WARN").otherwise("PASS")
    out = out.withColumns({"gain_db": 20 * F.log10(F.greatest("gain", F.lit(1e-15))), "attack_status": attack_status, "mono_status": mono_status})
    return out.select(
        "path", "lag_samples", "lag_ms", "correlation", "gain_db", "residual_db", F.coalesce("events_detected", F.lit(0)).alias("events_detected"), F.coalesce("events_used", F.lit(0)).alias("events_used"),
        "rms_delta", "contrast_delta", "guard", "attack_status", "worst_scope", "worst_delta", "mono_status", worst.alias("overall_status"),
    )
