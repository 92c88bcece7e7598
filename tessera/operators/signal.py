"""Audio as rows: files are decoded into frames, and levels, spectra and keys
are aggregates over those.

Only the decoding and the Fourier transform of a frame are Python, over Arrow
batches; a frame has a fixed number of samples, so a long file is many rows.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import loop_tempo
from tessera.operators import rhythm

FRAMES = "path string, rate int, channels int, frame long, left array<float>, right array<float>"
SILENCE_DB = -300.0

# Weights of the twelve pitch classes in major and minor keys (Krumhansl and Kessler, 1982).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples by channel, from -1 to 1, of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels)


def frames(files: DataFrame, size: int = 4096) -> DataFrame:
    """``path, rate, channels, frame, left, right`` of WAV files given as ``path,
    content``; the last frame is short, files that can't be read have no row,
    and mono has the same samples on both sides."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    rate, x = decode(content)
                except (wave.Error, EOFError, ValueError):
                    continue
                for i in range(0, len(x), size * 256):  # a bounded number of rows at once
                    starts = range(i, min(i + size * 256, len(x)), size)
                    yield pd.DataFrame({"path": path, "rate": rate, "channels": x.shape[1], "frame": [s // size for s in starts], "left": [x[s : s + size, 0] for s in starts], "right": [x[s : s + size, -1] for s in starts]})

    return files.select("path", "content").mapInPandas(run, FRAMES)


def _sum(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v.cast("double")))


def frame_levels(framed: DataFrame) -> DataFrame:
    """Sums of each frame: samples, squares, products, peak, and sign changes within it."""
    mid = F.zip_with("left", "right", lambda a, b: (a + b) / 2)
    pairs = F.zip_with(F.slice("left", 1, F.size("left") - 1), F.slice("left", 2, F.size("left") - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("int"))
    return framed.select(
        "path", "rate", "frame",
        F.size("left").alias("n"),
        _sum(F.col("left"), lambda v: v * v).alias("ll"),
        _sum(F.col("right"), lambda v: v * v).alias("rr"),
        _sum(mid, lambda v: v * v).alias("mm"),
        F.aggregate(F.zip_with("left", "right", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v).alias("lr"),
        F.greatest(F.array_max(F.transform("left", F.abs)), F.array_max(F.transform("right", F.abs))).alias("peak"),
        F.aggregate(pairs, F.lit(0), lambda s, v: s + v).alias("crossings"),
    )


def levels(framed: DataFrame, gate_db: float = -30.0) -> DataFrame:
    """One row a file: seconds, level, peak, level of the frames within ``gate_db``
    of the loudest, correlation of the sides, mono retention in dB, sign-change rate."""
    sums = frame_levels(framed).withColumn("p", (F.col("ll") + F.col("rr")) / 2 / F.col("n"))
    loudest = F.max("p").over(Window.partitionBy("path"))
    active = F.col("p") >= loudest * (10 ** (gate_db / 10))
    agg = sums.withColumn("active", active).groupBy("path").agg(
        (F.sum("n") / F.first("rate")).alias("seconds"),
        F.sqrt(F.sum("mm") / F.sum("n")).alias("rms"),
        F.max("peak").alias("peak"),
        F.sqrt(F.sum(F.when(F.col("active"), F.col("p") * F.col("n"))) / F.sum(F.when(F.col("active"), F.col("n")))).alias("active_rms"),
        F.try_divide(F.sum("lr"), F.sqrt(F.sum("ll") * F.sum("rr"))).alias("correlation"),
        F.sum("ll").alias("_l"), F.sum("rr").alias("_r"), F.sum("mm").alias("_m"),
        F.try_divide(F.sum("crossings"), F.sum("n") - F.count("*")).alias("sign_change_rate"),
    )
    stereo = (F.col("_l") + F.col("_r")) / 2
    return agg.withColumn("mono_retention_db", F.when(stereo > 0, 10 * F.log10(F.greatest(F.col("_m"), F.lit(1e-30)) / stereo))).drop("_l", "_r", "_m")


def retention_verdict(db: Column, warn: float = -0.5, fail: float = -1.5) -> Column:
    return F.when(db.isNull(), "UNKNOWN").when(db <= fail, "FAIL").when(db <= warn, "WARN").otherwise("PASS")


def spectra(framed: DataFrame, bands: int = 512) -> DataFrame:
    """``path, rate, frame, power``: the power of each frame's spectrum in bands of equal width up to half the rate."""

    @F.pandas_udf("array<double>")
    def power(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            x = (np.asarray(a, np.float64) + np.asarray(b, np.float64)) / 2
            s = np.abs(np.fft.rfft(x * np.hanning(len(x)), 2 * bands * max(1, -(-len(x) // (2 * bands))))) ** 2
            out.append(s[1:].reshape(bands, -1).sum(axis=1))
        return pd.Series(out)

    return framed.select("path", "rate", "frame", power("left", "right").alias("power"))


def spectral_shape(spectrum: DataFrame, share: float = 0.85) -> DataFrame:
    """``path, centroid_hz, rolloff_hz``: the mean frequency by power, and the first by which ``share`` of the power has come."""
    total = spectrum.select("path", "rate", F.posexplode("power").alias("band", "p")).groupBy("path", "rate", "band").agg(F.sum("p").alias("p"))
    hz = (F.col("band") + 0.5) * F.col("rate") / 2 / F.max("band").over(Window.partitionBy("path"))
    run = F.sum("p").over(Window.partitionBy("path").orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("p").over(Window.partitionBy("path"))
    marked = total.withColumns({"hz": hz, "run": run, "whole": whole}).filter("whole > 0")
    return marked.groupBy("path").agg((F.sum(F.col("hz") * F.col("p")) / F.sum("p")).alias("centroid_hz"), F.min(F.when(F.col("run") >= share * F.col("whole"), F.col("hz"))).alias("rolloff_hz"))


def estimate_key(chroma: DataFrame, by: str = "path") -> DataFrame:
    """``by, key, mode, r``: the key whose profile correlates best with the twelve
    values ``pitch, p`` of each group; ties go to the first in order. Groups of equal values have no row."""
    spark = chroma.sparkSession
    profiles = [(k, m, (k + i) % 12, w) for m, p in (("major", MAJOR), ("minor", MINOR)) for k in range(12) for i, w in enumerate(p)]
    table = spark.createDataFrame(profiles, "tonic int, mode string, pitch int, weight double")  # 288 rows
    own = Window.partitionBy(by)
    uneven = chroma.withColumn("_spread", F.max("p").over(own) - F.min("p").over(own)).filter("_spread > 0")  # equal values correlate with nothing
    fit = uneven.join(F.broadcast(table), "pitch").groupBy(by, "tonic", "mode").agg(F.corr("p", "weight").alias("r")).filter("r is not null and not isnan(r)")
    best = fit.groupBy(by).agg(F.max_by(F.struct("tonic", "mode", "r"), F.struct("r", (F.col("mode") == "major").alias("m"), (-F.col("tonic")).alias("t"))).alias("b"))
    return best.select(by, F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("b.tonic") + 1).alias("key"), F.col("b.mode").alias("mode"), F.col("b.r").alias("r"))


def chroma(spectrum: DataFrame, least_hz: float = 60.0, most_hz: float = 5000.0) -> DataFrame:
    """``path, pitch, p``: power by pitch class, C as 0."""
    n = F.size("power")
    rows = spectrum.select("path", "rate", n.alias("n"), F.posexplode("power").alias("band", "p"))
    hz = (F.col("band") + 0.5) * F.col("rate") / 2 / F.col("n")
    pitch = F.pmod(F.round(12 * F.log2(hz / 440.0)).cast("int") + 9, F.lit(12))
    return rows.filter(hz.between(least_hz, most_hz)).groupBy("path", pitch.alias("pitch")).agg(F.sum("p").alias("p"))


def features(framed: DataFrame, size: int, rate: int) -> DataFrame:
    """A row for each file of one rate: seconds, tempo, key, level, spectral shape and sign changes. Files
    under ten seconds have no tempo and no key; a short loop's tempo is made exact."""
    spectrum = spectra(framed)
    tempos = rhythm.tempo(rhythm.onset_strength(spectrum), rate / size)
    keys = estimate_key(chroma(spectrum)).select("path", "key", "mode")
    own = levels(framed).select("path", "seconds", "rms", "sign_change_rate")
    out = own.join(spectral_shape(spectrum), "path", "left").join(tempos, "path", "left").join(keys, "path", "left")
    long = F.col("seconds") >= 10
    bpm = F.round(loop_tempo("bpm", "seconds"), 2)
    rounded = [F.round("seconds", 3).alias("seconds"), F.round("rms", 6).alias("rms"), F.round("sign_change_rate", 6).alias("sign_change_rate"), F.round("centroid_hz", 2).alias("centroid_hz"), F.round("rolloff_hz", 2).alias("rolloff_hz")]
    return out.select("path", *rounded, F.when(long, bpm).alias("bpm"), F.when(long, F.col("key")).alias("key"), F.when(long, F.col("mode")).alias("mode"))


def normalised(framed: DataFrame) -> DataFrame:
    """Frames of mono means, brought down to a peak of 1 where a file exceeds it; files without samples have no row."""
    mono = F.zip_with("left", "right", lambda a, b: (a + b) / 2)
    peaks = framed.filter(F.size("left") > 0).groupBy("path").agg(F.max(F.array_max(F.transform(mono, F.abs))).alias("_peak"))
    scaled = F.transform(mono, lambda x: (x / F.greatest(F.col("_peak"), F.lit(1.0))).cast("float"))
    return framed.join(peaks, "path").select("path", "rate", F.lit(1).alias("channels"), "frame", scaled.alias("left"), scaled.alias("right"))
