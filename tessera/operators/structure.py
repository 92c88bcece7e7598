"""A file's temporal structure in one row: cepstra, rhythm, attacks and spectral peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import filters, rhythm, signal

# An attack's window and what of it comes before the onset in ms, its mel filters, and how many attacks of a file are compared.
WINDOW_MS, PREROLL_MS, MELS, MOST = 80.0, 30.0, 24, 64


def attack_vector(x: np.ndarray, rate: int) -> np.ndarray:
    """The log of one and the mean power of each mel filter, at length 1; zeros of silence or under 32 samples."""
    if len(x) < 32:
        return np.zeros(MELS)
    n = min(512, max(64, 1 << (len(x).bit_length() - 1)))
    hop = max(16, n // 4)
    x = np.concatenate([np.zeros(n // 2), x, np.zeros(n // 2)])
    cut = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    power = (np.abs(np.fft.rfft(cut * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))) ** 2).mean(axis=0)[1:]
    v = np.log1p(rhythm.mel_matrix(len(power), rate, MELS) @ power)
    norm = np.linalg.norm(v)
    return v / norm if norm > 1e-12 else np.zeros(MELS)


def attacks(framed: DataFrame, size: int, onset: DataFrame) -> DataFrame:
    """``path, w, vector, level, peak_ms`` of the first ``MOST`` onsets (``path, sample``) of each file, with the samples of all frames
    that an attack's window meets."""
    rates = framed.groupBy("path").agg(F.first("rate").alias("rate"))
    first = onset.withColumn("w", F.row_number().over(Window.partitionBy("path").orderBy("sample"))).filter(F.col("w") <= MOST).join(rates, "path")
    start = F.greatest(F.col("sample") - F.round(F.col("rate") * PREROLL_MS / 1000), F.lit(0)).cast("long")
    length = F.greatest(F.round(F.col("rate") * WINDOW_MS / 1000), F.lit(32)).cast("long")
    cut = filters.windows_of(framed, size, first.select("path", "w", start.alias("start"), length.alias("length")))

    @F.pandas_udf("vector array<double>, level double, peak_ms double")
    def measured(rate: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for r, a, b in zip(rate, left, right):
            x = (np.asarray(a, np.float64) + np.asarray(b, np.float64)) / 2
            rows.append((attack_vector(x, r), float(np.sqrt(np.mean(x * x))), 1000.0 * int(np.abs(x).argmax()) / r))
        return pd.DataFrame(rows, columns=["vector", "level", "peak_ms"])

    whole = cut.filter(F.size("left") >= 16)
    return whole.select("path", "w", measured("rate", "left", "right").alias("m")).select("path", "w", "m.*")


def attack_summary(attack: DataFrame) -> DataFrame:
    """``path, transient_count, attack_similarity_median, attack_similarity_p95, attack_energy_cv, attack_time_cv``: of
    all pairs of a file's attacks, ``MOST`` at most, exactly."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.asarray(v) for v in part["vector"]])
        pairs = (m @ m.T)[np.triu_indices(len(m), 1)]
        middle, high = (np.percentile(pairs, (50, 95)) if len(pairs) else (None, None))
        return pd.DataFrame({"path": [part["path"].iloc[0]], "attack_similarity_median": [middle], "attack_similarity_p95": [high]}).astype({"attack_similarity_median": float, "attack_similarity_p95": float})

    pairs = attack.select("path", "vector").groupBy("path").applyInPandas(run, "path string, attack_similarity_median double, attack_similarity_p95 double")
    pairs = pairs.select("path", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("attack_similarity_median", "attack_similarity_p95")))
    own = attack.groupBy("path").agg(F.count("*").alias("transient_count"), rhythm.variation(F.col("level")).alias("attack_energy_cv"), rhythm.variation(F.col("peak_ms")).alias("attack_time_cv"))
    return own.join(pairs, "path")


def profile(framed: DataFrame, size: int, rate: int, bands: int = 512) -> DataFrame:
    """A row for each file of one rate with frames of ``size`` samples: ``path, sample_rate_hz, duration_s, status`` and the sections ``mfcc, rhythm,
    transients, spectral_artifacts``; what a file is too short or too quiet for is null, and its counts are 0."""
    spectrum = signal.spectra(framed, bands)
    strength = rhythm.onset_strength(spectrum)
    onset = rhythm.onsets(strength)
    beat = rhythm.rhythm(onset, rhythm.tempo(strength, rate / size), rate / size)
    attack = attack_summary(attacks(framed, size, onset.select("path", (F.col("t") * size).alias("sample"))))
    cepstra = rhythm.trajectory(rhythm.cepstra(spectrum))
    peaks = rhythm.spectral_periodicity(spectrum)
    files = filters.samples(framed).select("path", F.lit(rate).alias("sample_rate_hz"), (F.col("samples") / rate).alias("duration_s"), F.lit("OK").alias("status"))
    rows = files.join(cepstra, "path", "left").join(beat, "path", "left").join(attack, "path", "left").join(peaks, "path", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(
        *files.columns,
        F.struct("delta_variance", "delta2_variance", "path_length", "acceleration_p95").alias("mfcc"),
        F.struct(count("onset_count"), "tempo_bpm", "off_grid_ms_median", "off_grid_ms_iqr", "gap_cv", "locked_ratio").alias("rhythm"),
        F.struct(count("transient_count"), "attack_similarity_median", "attack_similarity_p95", "attack_energy_cv", "attack_time_cv", "flux_cv").alias("transients"),
        F.struct(count("peaks"), "spacing_hz", "regularity", "persistence").alias("spectral_artifacts"),
    )
