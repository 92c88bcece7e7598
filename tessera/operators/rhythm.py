"""Onsets, tempo, attacks, spectral peaks and cepstra: series of rows made from
frames, and aggregates and windows over them.

A series has a row for each step of a file (``path, t, value``); windows over it
stay within a file. Python is used on the arrays of one frame, and for the
autocorrelation, the lag and the prominences of one file's series.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bands in which the loss of mono sums is judged, in Hz.
MONO_BANDS = [("low_20_120", 20.0, 120.0), ("low_mid_120_500", 120.0, 500.0), ("presence_500_4000", 500.0, 4000.0), ("high_4000_18000", 4000.0, 18000.0)]
N_MFCC, N_CHROMA, N_CONTRAST = 20, 12, 7  # Fixed values: the sizes of the three families of the acoustic vector
# Fixed values of the detector of attacks: windows and distances in ms, its weight of a rise, and the bounds of score, level and prominence.
FAST_MS, SLOW_MS, RISE_MS, DISTANCE_MS, MARGIN_MS = 8, 80, 16, 85, 180
ATTACK_WARN, ATTACK_FAIL = -0.75, -1.5  # Fixed values: the bounds in dB of what attacks may lose
RISE_WEIGHT, LEAST_SCORE, SCORE_SHARE, LEVEL_SHARE, LEVEL_RANGE_DB, PROMINENCE_DB = 0.35, 1.0, 0.70, 0.55, 38.0, 0.75


def none(**kinds: type) -> pd.DataFrame:
    """No rows of these columns."""
    return pd.DataFrame({k: pd.Series([], dtype=t) for k, t in kinds.items()})


def _file(*order: str) -> Window:
    return Window.partitionBy("path").orderBy(*order)


def step_sums(part: pd.DataFrame, step_ms: float) -> pd.DataFrame:
    """``path, t, n, a, p``: samples, amplitudes and powers of the steps of each frame of a batch, as one table: a table a frame costs far more than its sums."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
    for rate, frame, left, right, size in zip(part["rate"], part["frame"], part["left"], part["right"], part["size"]):
        x = (np.asarray(left, np.float64) + np.asarray(right, np.float64)) / 2
        if not len(x):
            found.append(found[0])
            continue
        at = ((frame * size + np.arange(len(x))) * 1000 / (rate * step_ms)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        found.append((at[first], np.diff(np.append(first, len(x))), np.add.reduceat(np.abs(x), first), np.add.reduceat(x * x, first)))
    t, n, a, p = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"path": np.repeat(part["path"].to_numpy(object), [len(f[0]) for f in found[1:]]), "t": t, "n": n, "a": a, "p": p})


def steps(framed: DataFrame, step_ms: float = 1.0) -> DataFrame:
    """``path, t, value, power``: the mean amplitude and power of each step of about
    ``step_ms``, ``t`` in steps from the file's start. Frames hold whole steps if
    their size is a multiple of them; a step that two frames share has two rows' mean."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (step_sums(part, step_ms) for part in parts)

    sizes = framed.groupBy("path").agg(F.max(F.size("left")).alias("size"))
    found = framed.join(sizes, "path").select("path", "rate", "frame", "left", "right", "size").mapInPandas(run, "path string, t long, n long, a double, p double")
    return found.groupBy("path", "t").agg((F.sum("a") / F.sum("n")).alias("value"), (F.sum("p") / F.sum("n")).alias("power"))


def moving_average(series: DataFrame, width: int, column: str = "value", out: str = "smooth") -> DataFrame:
    """Centred means of ``width`` steps; at the ends of those there are."""
    return series.withColumn(out, F.avg(column).over(_file("t").rowsBetween(-(width // 2), width - 1 - width // 2)))


def without_baseline(series: DataFrame, width: int = 9, column: str = "value", out: str = "residual") -> DataFrame:
    """What rises above the median of the ``width`` steps around."""
    middle = F.percentile(column, F.lit(0.5)).over(_file("t").rowsBetween(-(width // 2), width // 2))
    return series.withColumn(out, F.col(column) - middle)


def onset_strength(spectrum: DataFrame) -> DataFrame:
    """``path, t, value``: how much the log power of the bands rises from the frame before, on average."""
    before = F.lag("power").over(_file("frame"))
    level = lambda p: 10 * F.log10(F.greatest(p, F.lit(1e-10)))
    rises = F.zip_with("power", before, lambda a, b: F.greatest(level(a) - level(b), F.lit(0.0)))
    rise = F.aggregate(rises, F.lit(0.0), lambda s, x: s + x) / F.size("power")
    return spectrum.select("path", F.col("frame").alias("t"), F.coalesce(rise, F.lit(0.0)).alias("value"))


def onsets(strength: DataFrame, reach: int = 3, wide: int = 10, above: float = 0.07) -> DataFrame:
    """The steps that are the greatest within ``reach``, and above the mean around by a share of the file's greatest."""
    near = F.max("value").over(_file("t").rowsBetween(-reach, reach))
    mean = F.avg("value").over(_file("t").rowsBetween(-wide, wide))
    most = F.max("value").over(Window.partitionBy("path"))
    marked = strength.withColumns({"_near": near, "_mean": mean, "_most": most})
    return marked.filter((F.col("value") == F.col("_near")) & (F.col("value") > 0) & (F.col("value") >= F.col("_mean") + above * F.col("_most"))).select("path", "t", "value")


def refined_period(power: np.ndarray, lag: int, most: int = 32) -> float:
    """The period near ``lag`` of an autocorrelation, by a straight line through the places of its peaks at the multiples of the period,
    up to half of the series. A peak's place is the centre of the three values around it."""
    period, num, den = float(lag), 0.0, 0.0
    for m in range(1, most + 1):
        middle, reach = round(m * period), 1 if m == 1 else 2
        if middle + reach + 1 >= len(power) or (m > 1 and 2 * middle > len(power)):
            break
        at = middle - reach + int(power[middle - reach : middle + reach + 1].argmax())
        if at < 1:
            continue
        near = power[at - 1 : at + 2] - min(power[at - 1], power[at + 1], power[at])
        if near.sum() <= 0:
            continue
        num, den = num + m * (at + (near[2] - near[0]) / near.sum()), den + m * m
        period = num / den
    return period


def tempo(strength: DataFrame, steps_per_second: float, slowest: float = 45.0, fastest: float = 240.0) -> DataFrame:
    """``path, bpm``: the beat whose lag the onset strength correlates best with, tempos near 120 before others; no row where nothing
    rises. The lag is a whole number of steps, so the beat's period is refined by its multiples."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("t")["value"].to_numpy()
        x = x - x.mean()
        n = 1 << (2 * len(x) - 1).bit_length()
        power = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2)[: len(x)]
        lags = np.arange(max(1, int(60 * steps_per_second / fastest)), min(len(x), int(60 * steps_per_second / slowest) + 1))
        bpm = 60 * steps_per_second / np.maximum(lags, 1)
        near = np.convolve(np.pad(power, 1, mode="edge"), np.ones(3), "valid")  # a beat between two steps is spread over both
        score = near[lags] / np.maximum(len(x) - lags, 1) * np.exp(-0.5 * np.log2(bpm / 120) ** 2)
        if not len(lags) or score.max() <= 0:
            return none(path=object, bpm=float)
        best = int(lags[score.argmax()])
        best = max(best - 1, 1) + int(power[max(best - 1, 1) : best + 2].argmax())
        return pd.DataFrame({"path": [part["path"].iloc[0]], "bpm": [60 * steps_per_second / refined_period(power, best)]})

    return strength.groupBy("path").applyInPandas(run, "path string, bpm double")


def variation(x: Column) -> Column:
    """Standard deviation over the mean: null under two values; 0 where all are 0."""
    mean = F.avg(x)
    return F.when(F.count(x) < 2, F.lit(None)).when(F.abs(mean) > 1e-12, F.stddev_pop(x) / F.abs(mean)).when(F.max(F.abs(x)) <= 1e-8, 0.0)


def rhythm(onset: DataFrame, tempos: DataFrame, steps_per_second: float, parts: int = 4, lock_ms: float = 20.0) -> DataFrame:
    """A row for each file with onsets: their number, the variation of the gaps, and how far they lie
    from a grid of ``parts`` to a beat. The grid starts at the mean place of the onsets between its lines, weighed by strength: a first onset may
    be cut off by the file's start."""
    s = F.col("t") / steps_per_second
    unit = 60.0 / F.col("bpm") / parts
    rows = onset.join(tempos, "path", "left").withColumns({"s": s, "gap": s - F.lag(s).over(_file("t")), "turn": 2 * F.pi() * s / unit})
    whole = Window.partitionBy("path")
    start = F.atan2(F.sum(F.col("value") * F.sin("turn")).over(whole), F.sum(F.col("value") * F.cos("turn")).over(whole))
    phase = (F.col("turn") - F.col("start")) / (2 * F.pi())
    rows = rows.withColumn("start", start).withColumn("off", F.abs(phase - F.rint(phase)) * unit * 1000)
    p = lambda q: F.percentile("off", F.lit(q))
    return rows.groupBy("path").agg(
        F.count("*").alias("onset_count"), F.first("bpm").alias("tempo_bpm"), variation(F.col("gap")).alias("gap_cv"), variation(F.col("value")).alias("flux_cv"),
        p(0.5).alias("off_grid_ms_median"), (p(0.75) - p(0.25)).alias("off_grid_ms_iqr"), F.avg((F.col("off") <= lock_ms).cast("double")).alias("locked_ratio"),
    )


def prominences(score: np.ndarray, valley: np.ndarray) -> np.ndarray:
    """How far each peak of a series stands above what separates it from higher ones. ``valley`` has the least value before the first
    peak, between neighbours, and after the last."""

    def lowest(own, between) -> np.ndarray:
        out, stack = np.empty(len(own)), []
        for i, s in enumerate(own):
            low = between[i]
            while stack and stack[-1][0] <= s:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((s, low))
        return out

    right = lowest(score[::-1], valley[::-1])[::-1]
    return score - np.maximum(lowest(score, valley), right)


def apart(t: np.ndarray, score: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay if none may have a higher one that stays nearer than ``distance``; of equal ones the later stays."""
    stay = np.ones(len(t), bool)
    for i in np.argsort(score, kind="stable")[::-1]:
        if stay[i]:
            for step in (-1, 1):
                k = i + step
                while 0 <= k < len(t) and abs(t[k] - t[i]) < distance:
                    stay[k] = False
                    k += step
    return stay


def transients(series: DataFrame, step_ms: float = 1.0, most: int = 64) -> DataFrame:
    """``path, t, score, detected``: the strongest attacks, in the order of time, and how many there were. The score is how far
    the level of ``FAST_MS`` rises above that of ``SLOW_MS``, and above itself ``RISE_MS`` before. Attacks are peaks of the score that are apart,
    high and prominent, loud enough, and have ``MARGIN_MS`` on both sides. A file's peaks, not its series, meet in one task."""
    wide = lambda ms: max(1, int(ms / step_ms))
    s = moving_average(moving_average(series, wide(FAST_MS), "power", "_fast"), wide(SLOW_MS), "power", "_slow")
    db = lambda c: 10 * F.log10(F.greatest(F.col(c), F.lit(1e-18)))
    s = s.withColumn("_level", db("_fast"))
    rise = F.greatest(F.col("_level") - F.coalesce(F.lag("_level", wide(RISE_MS)).over(_file("t")), F.col("_level")), F.lit(0.0))
    s = s.withColumn("score", F.col("_level") - db("_slow") + RISE_WEIGHT * rise)
    before, after = F.lag("score").over(_file("t")), F.lead("score").over(_file("t"))
    s = s.withColumn("_peak", F.coalesce((F.col("score") > before) & (F.col("score") >= after), F.lit(False)))
    s = s.withColumn("_part", F.sum(F.col("_peak").cast("long")).over(_file("t")))
    bounds = s.groupBy("path").agg(
        F.greatest(F.percentile("_level", F.lit(LEVEL_SHARE)), F.max("_level") - LEVEL_RANGE_DB).alias("floor"), F.greatest(F.lit(LEAST_SCORE), F.percentile("score", F.lit(SCORE_SHARE))).alias("least"), F.max("t").alias("last")
    )
    parts = s.groupBy("path", "_part").agg(F.min("score").alias("valley"), F.max(F.when(F.col("_peak"), F.struct("t", "score", "_level"))).alias("peak"))
    parts = parts.select("path", F.col("_part").alias("part"), "valley", "peak.t", "peak.score", F.col("peak._level").alias("level")).join(bounds, "path")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(rows["part"].to_numpy())
        number, low, t, score, level, floor, least, last = (rows[c].to_numpy()[order] for c in ("part", "valley", "t", "score", "level", "floor", "least", "last"))
        own = number > 0
        if not own.any():
            return none(path=object, t=int, score=float, detected=int)
        valley = np.concatenate([low[~own][:1] if not own.all() else score[:1], low[own]])
        t, score, level, floor, least, last = (c[own] for c in (t, score, level, floor, least, last))
        t = t.astype(np.int64)
        rise = prominences(score, valley)
        high = np.flatnonzero(score >= least)
        high = high[apart(t[high], score[high], wide(DISTANCE_MS))]
        margin = wide(MARGIN_MS)
        stay = high[(rise[high] >= PROMINENCE_DB) & (level[high] >= floor[high]) & (t[high] >= margin) & (t[high] <= last[high] - margin)]
        best = np.sort(stay[np.lexsort((t[stay], -level[stay], -score[stay]))][:most])  # peaks lie in the order of time
        if not len(best):
            return none(path=object, t=int, score=float, detected=int)
        return pd.DataFrame({"path": [rows["path"].iloc[0]] * len(best), "t": t[best], "score": score[best], "detected": len(stay)})

    return parts.groupBy("path").applyInPandas(run, "path string, t long, score double, detected long")


def around(series: DataFrame, events: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """``path, t`` and for each span (in steps from an event) the mean ``power`` and greatest ``value``: a join of
    the steps with the events that they are near to, by blocks of steps, and one aggregation."""
    low, high = min(a for a, _ in spans.values()), max(b for _, b in spans.values())
    block = high - low
    at = events.select("path", F.col("t").alias("event"), F.explode(F.sequence(F.floor((F.col("t") + low) / block), F.floor((F.col("t") + high) / block))).alias("block"))
    near = series.withColumn("block", F.floor(F.col("t") / block)).join(at, ["path", "block"]).withColumn("_d", F.col("t") - F.col("event"))
    inside = lambda a, b: (F.col("_d") >= a) & (F.col("_d") < b)
    aggs = [x for name, (a, b) in spans.items() for x in (F.avg(F.when(inside(a, b), F.col("power"))).alias(f"{name}_power"), F.max(F.when(inside(a, b), F.col("value"))).alias(f"{name}_peak"))]
    return near.filter(inside(low, high)).groupBy("path", F.col("event").alias("t")).agg(*aggs)


def transient_retention(reference: DataFrame, candidate: DataFrame, events: DataFrame, lag: int = 0, step_ms: float = 1.0, warn: float = ATTACK_WARN, fail: float = ATTACK_FAIL) -> DataFrame:
    """``path, events, rms_delta, contrast_delta, guard, status``: how attacks at ``events`` of the reference came through in the
    candidate, which is ``lag`` steps later. Medians over events of the attack's level, and of attack peak to sustain; the worse is judged."""
    wide = lambda ms: round(ms / step_ms)
    spans = {"attack": (-wide(5), wide(35)), "sustain": (wide(45), wide(145))}
    a = around(reference, events, spans)
    b = around(candidate, events.withColumn("t", F.col("t") + lag), spans).withColumn("t", F.col("t") - lag)
    db = lambda side, c, f: f * F.log10(F.greatest(F.col(f"{side}.{c}"), F.lit(1e-15)))
    level = lambda s: db(s, "attack_power", 10)
    contrast = lambda s: db(s, "attack_peak", 20) - db(s, "sustain_power", 10)
    rows = a.alias("a").join(b.alias("b"), ["path", "t"]).select("path", (level("b") - level("a")).alias("rms"), (contrast("b") - contrast("a")).alias("contrast"))
    out = rows.groupBy("path").agg(F.count("*").alias("events"), F.percentile("rms", F.lit(0.5)).alias("rms_delta"), F.percentile("contrast", F.lit(0.5)).alias("contrast_delta"))
    out = out.withColumn("guard", F.least("rms_delta", "contrast_delta"))
    return out.withColumn("status", F.when(F.col("guard").isNull() | (F.col("guard") < fail), "FAIL").when(F.col("guard") < warn, "WARN").otherwise("PASS"))


def best_lag(reference: DataFrame, candidate: DataFrame, most: int) -> DataFrame:
    """``path, lag, correlation``: by how many steps the candidate is late, from the smoothed values of both."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return none(path=object, lag=int, correlation=float)
        x, y = (p["smooth"].to_numpy()[np.argsort(p["t"].to_numpy())] for p in (a, b))
        x, y = x - x.mean(), y - y.mean()
        n = 1 << (len(x) + len(y)).bit_length()
        c = np.fft.irfft(np.fft.rfft(y, n) * np.conj(np.fft.rfft(x, n)), n)
        lags = np.arange(-min(most, len(x) - 1), min(most, len(y) - 1) + 1)
        norm = np.linalg.norm(x) * np.linalg.norm(y)
        best = int(lags[np.argmax(c[lags])]) if norm > 0 else 0
        return pd.DataFrame({"path": [a["path"].iloc[0]], "lag": [best], "correlation": [float(c[best] / norm) if norm > 0 else 0.0]})

    return reference.groupBy("path").cogroup(candidate.groupBy("path")).applyInPandas(run, "path string, lag long, correlation double")


def mean_spectrum(spectrum: DataFrame) -> DataFrame:
    """``path, rate, t, value``: the mean amplitude of each band in dB below the greatest; ``t`` is the band."""
    means = spectrum.select("path", "rate", F.posexplode("power").alias("t", "p")).groupBy("path", "rate", "t").agg(F.avg(F.sqrt("p")).alias("a"))
    top = F.max("a").over(Window.partitionBy("path"))
    return means.select("path", "rate", "t", F.greatest(20 * F.log10(F.greatest(F.col("a"), F.lit(1e-12)) / F.greatest(top, F.lit(1e-12))), F.lit(-80.0)).alias("value"))


def prominent_peaks(series: DataFrame, column: str = "residual", least: float = 4.0, most: int = 24) -> DataFrame:
    """``path, t, prominence``: the ``most`` peaks of a series of bounded length (such as a spectrum) that rise most above what
    separates them from higher ones, in order, with the number of all."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        x, t = part[column].to_numpy(), part["t"].to_numpy()
        rows = []
        for i in np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1:
            higher = np.flatnonzero(x > x[i])
            left, right = higher[higher < i], higher[higher > i]
            a, b = (left[-1] if len(left) else 0), (right[0] if len(right) else len(x) - 1)
            rise = x[i] - max(x[a : i + 1].min(), x[i : b + 1].min())
            if rise >= least:
                rows.append((part["path"].iloc[0], t[i], rise))
        if not rows:
            return none(path=object, t=int, prominence=float, peaks=int)
        best = sorted(sorted(rows, key=lambda r: (-r[2], r[1]))[:most], key=lambda r: r[1])
        return pd.DataFrame([(*r, len(rows)) for r in best], columns=["path", "t", "prominence", "peaks"])

    return series.groupBy("path").applyInPandas(run, "path string, t long, prominence double, peaks long")


def spectral_periodicity(spectrum: DataFrame, from_hz: float = 1000.0) -> DataFrame:
    """``path, peaks, spacing_hz, regularity, persistence``: whether the spectrum's peaks lie in even distances, and in how many frames they stand 3 dB
    above the bands around."""
    mean = mean_spectrum(spectrum)
    bands = spectrum.groupBy("path").agg(F.max(F.size("power")).alias("bands"), F.first("rate").alias("_rate"))
    hz = F.col("_rate") / 2 / F.col("bands")
    high = mean.join(bands, "path").filter((F.col("t") + 0.5) * hz >= from_hz).select("path", "t", "value")
    peaks = prominent_peaks(without_baseline(high))
    gaps = peaks.join(bands, "path").withColumn("_gap", (F.col("t") - F.lag("t").over(_file("t"))) * hz)
    near = lambda c: F.transform(F.slice(c, F.greatest(F.col("t") - 3, F.lit(1)).cast("int"), 9), lambda p: 10 * F.log10(F.greatest(p, F.lit(1e-18))))
    stands = spectrum.join(peaks.select("path", "t"), "path").withColumn("_near", F.sort_array(near("power")))
    own = 10 * F.log10(F.greatest(F.get("power", F.col("t").cast("int")), F.lit(1e-18)))
    stands = stands.groupBy("path").agg(F.avg((own - F.get("_near", F.floor(F.size("_near") / 2).cast("int")) >= 3).cast("double")).alias("persistence"))
    out = gaps.groupBy("path").agg(F.first("peaks").alias("peaks"), F.percentile("_gap", F.lit(0.5)).alias("spacing_hz"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop("_gap") / F.avg("_gap"))).alias("regularity"))
    return out.join(stands, "path", "left")


@lru_cache(maxsize=64)
def mel_matrix(bands: int, rate: int, filters: int) -> np.ndarray:
    """Triangles evenly spaced in mels, over bands of equal width up to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), filters + 2) / 2595) - 1)
    hz = (np.arange(bands) + 0.5) * rate / 2 / bands
    up, down = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=64)
def cosine_matrix(n: int, filters: int) -> np.ndarray:
    """The orthonormal cosine transform's first ``n`` rows."""
    m = np.cos(np.pi / filters * (np.arange(filters) + 0.5) * np.arange(n)[:, None]) * np.sqrt(2 / filters)
    m[0] /= np.sqrt(2)
    return m


def cepstra(spectrum: DataFrame, n: int = 13, filters: int = 40) -> DataFrame:
    """``path, frame, cepstrum``: the cosine transform of the log power of each frame's mel filters."""

    @F.pandas_udf("array<double>")
    def of(power: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for p, r in zip(power, rate):
            level = 10 * np.log10(np.maximum(mel_matrix(len(p), r, filters) @ p, 1e-10))
            out.append(cosine_matrix(n, filters) @ level)
        return pd.Series(out)

    return spectrum.select("path", "frame", of("power", "rate").alias("cepstrum"))


def trajectory(cepstrum: DataFrame) -> DataFrame:
    """``path, delta_variance, delta2_variance, path_length, acceleration_p95`` of the cepstra's way: slopes and curvatures are those of
    parabolas through nine frames, the ends continued by their last values."""
    rows = cepstrum.select("path", F.col("frame").alias("t"), F.posexplode("cepstrum").alias("i", "x"))
    w = Window.partitionBy("path", "i").orderBy("t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.col("x") if k == 0 else F.coalesce(F.lead("x", k).over(w), F.last("x").over(whole)) if k > 0 else F.coalesce(F.lag("x", -k).over(w), F.first("x").over(whole))
    slope = sum(k * at(k) for k in range(-4, 5)) / 60.0
    curve = sum(c * at(k) for k, c in zip(range(-4, 5), (28, 7, -8, -17, -20, -17, -8, 7, 28))) / 462.0
    rows = rows.withColumns({"step": F.col("x") - F.lag("x").over(w), "slope": slope, "curve": curve})
    each = rows.groupBy("path", "i").agg(F.var_pop("slope").alias("v1"), F.var_pop("curve").alias("v2")).groupBy("path").agg(F.avg("v1").alias("delta_variance"), F.avg("v2").alias("delta2_variance"))
    norms = rows.groupBy("path", "t").agg(F.sqrt(F.sum(F.col("step") * F.col("step"))).alias("step"), F.sqrt(F.sum(F.col("curve") * F.col("curve"))).alias("curve"))
    return each.join(norms.groupBy("path").agg(F.avg("step").alias("path_length"), F.percentile("curve", F.lit(0.95)).alias("acceleration_p95")), "path")


def acoustic_vectors(spectrum: DataFrame, filters: int = 128) -> DataFrame:
    """``path, vector``: 78 numbers at length 1 in three families of equal weight: mean and deviation over the frames of 20 cepstra,
    12 pitch classes, and the contrast of 7 octave bands. Files without power have no row. Frames without power are left out
    where they are measured: a filter on the power would have the spectra made twice, in Python workers of their own."""

    @F.pandas_udf("array<double>")
    def of(power: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for p, r in zip(power, rate):
            if p is None or (p := np.asarray(p, np.float64)).sum() <= 0:
                out.append(None)
                continue
            hz = (np.arange(len(p)) + 0.5) * r / 2 / len(p)
            mel = cosine_matrix(N_MFCC, filters) @ (10 * np.log10(np.maximum(mel_matrix(len(p), r, filters) @ p, 1e-10)))
            pitch = np.bincount(np.mod(np.round(12 * np.log2(hz / 440.0)).astype(int) + 9, 12), p, N_CHROMA)
            edges = np.searchsorted(hz, [0, *(200.0 * 2 ** np.arange(N_CONTRAST - 1)), r])
            contrast = []
            for a, b in zip(edges[:-1], edges[1:]):
                band = np.sort(p[a:b]) if b > a else np.zeros(1)
                k = max(1, int(round(0.02 * len(band))))
                contrast.append(10 * np.log10(max(band[-k:].mean(), 1e-10)) - 10 * np.log10(max(band[:k].mean(), 1e-10)))
            out.append(np.concatenate([mel, pitch / (pitch.max() or 1.0), contrast]))
        return pd.Series(out)

    stats = spectrum.select("path", F.posexplode(of("power", "rate")).alias("i", "x")).groupBy("path", "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    family = F.when(F.col("i") < N_MFCC, 0).when(F.col("i") < N_MFCC + N_CHROMA, 1).otherwise(2)
    both = stats.select("path", family.alias("family"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("i"), F.col("mean").alias("x")), F.struct(F.lit(1).alias("k"), F.col("i"), F.col("deviation").alias("x")))).alias("s")).select("path", "family", "s.*")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("path", "family")))
    scaled = both.withColumn("y", F.when(norm > 0, F.col("x") / norm / F.sqrt(F.lit(3.0))))
    return scaled.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("family", "k", "i", "y"))), lambda s: s["y"]).alias("vector")).filter(F.forall("vector", lambda v: v.isNotNull()))


def band_retention(framed: DataFrame, spectra) -> DataFrame:
    """``path, band, retention_db`` of the mono sum of two sides by band, and the ``worst`` of a file; ``spectra`` gives frames' spectra."""
    mid = F.zip_with("left", "right", lambda a, b: (a + b) / 2)
    side = lambda name, x: spectra(framed.withColumns({"left": x, "right": x})).select("path", "rate", "frame", F.posexplode("power").alias("i", "p"), F.lit(name).alias("side"), F.size("power").alias("n"))
    rows = side("l", F.col("left")).union(side("r", F.col("right"))).union(side("m", mid))
    hz = (F.col("i") + 0.5) * F.col("rate") / 2 / F.col("n")
    band = F.lit(None).cast("string")
    for name, low, high in MONO_BANDS:
        band = F.when((hz >= low) & (hz < high), name).otherwise(band)
    total = lambda s: F.sum(F.when(F.col("side") == s, F.col("p")).otherwise(0.0))
    sums = rows.withColumn("band", band).filter("band is not null").groupBy("path", "band").agg(((total("l") + total("r")) / 2).alias("stereo"), total("m").alias("mono"))
    out = sums.select("path", "band", F.when(F.col("stereo") > 0, 10 * F.log10(F.greatest(F.col("mono"), F.lit(1e-30)) / F.col("stereo"))).alias("retention_db"))
    return out.withColumn("worst", F.min_by("band", "retention_db").over(Window.partitionBy("path")))


def interval(framed: DataFrame, size: int, start_s: float, end_s: float) -> DataFrame:
    """The frames of a time interval, the first and last cut to it; frames have ``size`` samples."""
    if not 0 <= start_s < end_s:
        raise ValueError("an interval has 0 <= start < end")
    low, high = F.round(F.lit(start_s) * F.col("rate")), F.round(F.lit(end_s) * F.col("rate"))
    base = F.col("frame") * size
    a, b = F.greatest(low - base, F.lit(0)).cast("int"), F.least(high - base, F.size("left")).cast("int")
    cut = lambda c: F.slice(c, a + 1, b - a).alias(c)
    return framed.filter(b > a).select("path", "rate", "channels", "frame", cut("left"), cut("right"))


def at_level(framed: DataFrame, target: float = 0.1, least_db: float = -80.0) -> DataFrame:
    """Frames scaled so that a file's level is ``target``; files below ``least_db`` have no row."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    mono = F.zip_with("left", "right", lambda a, b: (a + b) / 2)
    levels = framed.groupBy("path").agg(F.sqrt(F.sum(square(mono)) / F.sum(F.size("left"))).alias("_level")).filter(F.col("_level") >= 10 ** (least_db / 20))
    gain = lambda c: F.transform(c, lambda x: (x * (F.lit(target) / F.col("_level"))).cast("float")).alias(c)
    return framed.join(levels, "path").select("path", "rate", "channels", "frame", gain("left"), gain("right"))


def resampled(framed: DataFrame, size: int, rate: int, reach: int = 16) -> DataFrame:
    """Frames of ``size`` samples at another rate. Each frame is filtered with the ends of its neighbours (a windowed sinc of
    ``reach`` zero crossings), so files may be as long as they like."""
    w = _file("frame")
    ends = {f"_{s}_{k}": v for s in ("left", "right") for k, v in (("before", F.coalesce(F.lag(s).over(w), F.array().cast("array<float>"))), ("after", F.coalesce(F.lead(s).over(w), F.array().cast("array<float>"))))}
    columns = ["path", "rate", "frame", "left", "right", *ends]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                row = dict(zip(columns, r))
                ratio = rate / row["rate"]
                cut = min(1.0, ratio)
                need = int(np.ceil(reach / cut))
                base = row["frame"] * size
                at = np.arange(int(np.ceil(base * ratio)), int(np.ceil((base + len(row["left"])) * ratio))) / ratio - base
                sides = []
                for s in ("left", "right"):
                    before, after = np.asarray(row[f"_{s}_before"], np.float64)[-need:], np.asarray(row[f"_{s}_after"], np.float64)[:need]
                    x = np.concatenate([np.zeros(need - len(before)), before, np.asarray(row[s], np.float64), after, np.zeros(need + 1 - len(after))])
                    place = np.floor(at).astype(np.int64)[:, None] + np.arange(1 - need, need + 1)
                    d = (at[:, None] - place) * cut
                    kernel = cut * np.sinc(d) * np.where(np.abs(d) < reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0)
                    sides.append((x[np.clip(place + need, 0, len(x) - 1)] * kernel).sum(axis=1).astype(np.float32))
                rows.append((row["path"], rate, row["frame"], *sides))
            yield pd.DataFrame(rows, columns=["path", "rate", "frame", "left", "right"])

    return framed.select(*columns[:5], *[v.alias(k) for k, v in ends.items()]).mapInPandas(run, "path string, rate int, frame long, left array<float>, right array<float>")


def active_level(series: DataFrame, wide: int = 400, hop: int = 200, gate_db: float = -30.0) -> DataFrame:
    """``path, level``: the level of the windows of ``wide`` steps, every ``hop``, that lie within ``gate_db`` of the loudest. A file shorter than a window is one."""
    over = _file("t").rowsBetween(0, wide - 1)
    rows = series.withColumns({"_n": F.count("*").over(over), "_p": F.avg("power").over(over), "_all": F.count("*").over(Window.partitionBy("path"))})
    whole = rows.filter((F.col("t") % hop == 0) & ((F.col("_n") == wide) | (F.col("_all") < wide) & (F.col("t") == 0)))
    loudest = F.max("_p").over(Window.partitionBy("path"))
    return whole.withColumn("_loudest", loudest).filter(F.col("_p") >= F.col("_loudest") * 10 ** (gate_db / 10)).groupBy("path").agg(F.sqrt(F.avg("_p")).alias("level"))


def level_gain(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """``path, gain``: what brings the candidate to the reference's active level; 1 where one is silent."""
    a, b = active_level(reference).withColumnRenamed("level", "_a"), active_level(candidate).withColumnRenamed("level", "_b")
    return a.join(b, "path").select("path", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_a") / F.col("_b")).otherwise(1.0).alias("gain"))
