import io
import math
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import rhythm, signal

RATE, SIZE = 8000, 512


def wav(x, rate=RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def clicks(bpm, seconds, late=0, loud=0.8, rate=RATE):
    x = np.zeros(int(seconds * rate))
    burst = loud * np.exp(-np.arange(int(0.06 * rate)) / (0.012 * rate)) * np.sin(2 * np.pi * 900 * np.arange(int(0.06 * rate)) / rate)
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * rate) + late
        x[at : at + len(burst)] += burst[: max(0, len(x) - at)]
    return x


@pytest.fixture(scope="module")
def framed(spark):
    t = np.arange(6 * RATE) / RATE
    comb = sum(0.05 * np.sin(2 * np.pi * f * t) for f in range(1200, 3600, 200)) + 0.001 * np.random.default_rng(1).normal(size=len(t))
    a, b = clicks(120, 12), clicks(90, 12)
    rows = [("a", wav(np.stack([a, a], 1))), ("b", wav(np.stack([b, -b], 1))), ("comb", wav(np.stack([comb, comb], 1))), ("silence", wav(np.zeros((RATE * 3, 1))))]
    return signal.frames(spark.createDataFrame(rows, "path string, content binary"), SIZE).persist()


def by_path(df):
    return {r.path: r for r in df.collect()}


def test_tempo_and_grid(spark):
    a = clicks(120, 12)
    files = spark.createDataFrame([("a", wav(np.stack([a, a], 1))), ("silence", wav(np.zeros((RATE * 3, 1))))], "path string, content binary")
    strength = rhythm.onset_strength(signal.spectra(signal.frames(files, 128), 32))  # 16 ms a frame
    tempos = rhythm.tempo(strength, RATE / 128)
    assert abs(by_path(tempos)["a"].bpm - 120) < 1 and "silence" not in by_path(tempos)
    found = by_path(rhythm.rhythm(rhythm.onsets(strength, reach=8, wide=30), tempos, RATE / 128))
    assert 22 <= found["a"].onset_count <= 25 and found["a"].gap_cv < 0.1 and found["a"].locked_ratio > 0.7 and "silence" not in found


def test_series_windows(spark):
    rows = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate([1, 1, 9, 1, 1, 1, 5, 5, 5, 5])], "path string, t long, value double")
    smooth = [r.smooth for r in rhythm.moving_average(rows, 3).orderBy("t").collect()]
    assert smooth[0] == 1 and math.isclose(smooth[2], 11 / 3) and smooth[9] == 5
    assert [r.residual for r in rhythm.without_baseline(rows, 5).orderBy("t").collect()][2] == 8


def test_transients_and_their_retention(spark, framed):
    series = rhythm.steps(framed.filter("path = 'a'"))
    events = rhythm.transients(series)
    assert 18 <= events.count() <= 24 and all(abs((r.t + 20) % 500 - 20) <= 20 for r in events.collect())
    assert rhythm.transients(series, most=5).count() == 5
    soft = clicks(120, 12, late=400, loud=0.8 * 10 ** (-1 / 20))
    other = rhythm.steps(signal.frames(spark.createDataFrame([("a", wav(np.stack([soft, soft], 1)))], "path string, content binary"), SIZE))
    lag = rhythm.best_lag(rhythm.moving_average(series, 20), rhythm.moving_average(other, 20), 200).first()
    assert lag.lag == 50 and lag.correlation > 0.95
    got = rhythm.transient_retention(series, other, events, lag=50).first()
    assert math.isclose(got.rms_delta, -1, abs_tol=0.05) and abs(got.contrast_delta) < 0.2 and got.status == "WARN"
    assert rhythm.transient_retention(series, series, events).first().status == "PASS"


def test_peaks_in_even_distances(framed):
    got = by_path(rhythm.spectral_periodicity(signal.spectra(framed.filter("path = 'comb'"), 256)))["comb"]
    assert got.peaks >= 10 and abs(got.spacing_hz - 200) < 20 and got.regularity > 0.85 and got.persistence > 0.9


def test_trajectory_of_cepstra(spark, framed):
    got = by_path(rhythm.trajectory(rhythm.cepstra(signal.spectra(framed, 128))))
    assert got["a"].path_length > got["comb"].path_length > got["silence"].path_length == 0 and got["a"].delta_variance > got["comb"].delta_variance
    line = spark.createDataFrame([("p", i, [2.0 * i, float(i * i)]) for i in range(40)], "path string, frame long, cepstrum array<double>")
    r = rhythm.trajectory(line).first()
    assert math.isclose(r.path_length, np.mean([math.hypot(2, 2 * i + 1) for i in range(39)]))
    assert rhythm.cosine_matrix(5, 40) @ rhythm.cosine_matrix(5, 40).T == pytest.approx(np.eye(5), abs=1e-9)


def test_acoustic_vectors(framed):
    vectors = by_path(rhythm.acoustic_vectors(signal.spectra(framed, 256)))
    assert set(vectors) == {"a", "comb"}  # the sides of b cancel
    for r in vectors.values():
        assert len(r.vector) == 78 and math.isclose(sum(x * x for x in r.vector), 1)
        assert math.isclose(sum(x * x for x in r.vector[:40]), 1 / 3) and math.isclose(sum(x * x for x in r.vector[40:64]), 1 / 3)


def test_bands_of_the_mono_sum(framed):
    got = {(r.path, r.band): r for r in rhythm.band_retention(framed.filter("path IN ('a', 'b')"), lambda f: signal.spectra(f, 128)).collect()}
    assert abs(got["a", "presence_500_4000"].retention_db) < 1e-6 and got["b", "presence_500_4000"].retention_db < -60
    assert got["b", "presence_500_4000"].worst in {b for p, b in got if p == "b"}


def test_interval_and_level(framed):
    cut = rhythm.interval(framed.filter("path = 'comb'"), SIZE, 1.0, 2.5)
    assert cut.agg(F.sum(F.size("left"))).first()[0] == int(1.5 * RATE)
    level = by_path(signal.levels(rhythm.at_level(framed)))
    assert math.isclose(level["comb"].rms, 0.1, rel_tol=1e-3) and "silence" not in level
    with pytest.raises(ValueError):
        rhythm.interval(framed, SIZE, 2.0, 1.0)


def test_resampling_keeps_tones(spark):
    t = np.arange(3 * RATE) / RATE
    tone = 0.5 * np.sin(2 * np.pi * 440 * t)
    framed = signal.frames(spark.createDataFrame([("p", wav(np.stack([tone, tone], 1)))], "path string, content binary"), SIZE)
    for rate in (4000, 11025):
        out = np.concatenate([r.left for r in rhythm.resampled(framed, SIZE, rate).orderBy("frame").collect()])
        assert abs(len(out) - 3 * rate) <= 1
        want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(out)) / rate)
        assert np.abs(out - want)[100:-100].max() < 0.01


def test_features_of_files(spark):
    a = clicks(120, 31)  # no short loop, whose 60 or 80 would be as good
    t = np.arange(3 * RATE) / RATE
    rows = [("long", wav(np.stack([a, a], 1))), ("short", wav(np.stack([0.5 * np.sin(2 * np.pi * 440 * t)] * 2, 1)))]
    framed = signal.frames(spark.createDataFrame(rows, "path string, content binary"), 128)
    got = by_path(signal.features(framed, 128, RATE))
    assert abs(got["long"].bpm - 120) < 1 and got["short"].bpm is None and got["short"].key is None
    assert got["short"].seconds == 3 and abs(got["short"].rms - 0.5 / math.sqrt(2)) < 1e-3 and abs(got["short"].centroid_hz - 440) < 60


def test_active_levels_and_peaks(spark, framed):
    series = rhythm.steps(framed.filter("path IN ('a', 'comb')"))
    levels = by_path(rhythm.active_level(series))
    whole = by_path(signal.levels(framed))
    assert math.isclose(levels["comb"].level, whole["comb"].rms, rel_tol=0.02)
    quiet = series.withColumn("power", F.col("power") / 4)
    assert all(math.isclose(r.gain, 2, rel_tol=1e-6) for r in rhythm.level_gain(series, quiet).collect())
    loud = framed.filter("path = 'comb'").withColumns({c: F.transform(c, lambda x: (x * 8).cast("float")) for c in ("left", "right")})
    peak = signal.levels(signal.normalised(loud)).first().peak
    assert math.isclose(peak, 1, rel_tol=1e-6)


def test_a_batch_of_frames_gives_one_table_of_steps():
    r = np.random.default_rng(6)
    frames = [("a", 0, r.normal(size=40)), ("a", 1, r.normal(size=17)), ("b", 0, np.empty(0)), ("c", 3, r.normal(size=40))]
    part = pd.DataFrame([(p, 8000, k, x, -x / 2, 40) for p, k, x in frames], columns=["path", "rate", "frame", "left", "right", "size"])
    got = rhythm.step_sums(part, 1.0)
    want = {}
    for p, k, x in frames:
        for i, v in enumerate(x / 4):
            n, a, q = want.get((p, (40 * k + i) // 8), (0, 0.0, 0.0))
            want[p, (40 * k + i) // 8] = (n + 1, a + abs(v), q + v * v)
    assert list(zip(got["path"], got["t"])) == list(want)
    for row, value in zip(got[["n", "a", "p"]].to_numpy(float), want.values()):
        assert row == pytest.approx(value)
    assert not len(rhythm.step_sums(part[part["path"] == "b"], 1.0)) and not len(rhythm.step_sums(part[:0], 1.0))


def test_spectra_for_acoustic_vectors_are_made_once(spark):
    tone = [float(v) for v in np.sin(np.arange(64) / 3)]
    schema = "path string, rate int, channels int, frame long, left array<float>, right array<float>"
    silent, rows = [0.0] * 64, []
    for k in range(4):
        rows += [("mixed", 8000, 2, 2 * k, tone, tone), ("mixed", 8000, 2, 2 * k + 1, silent, silent), ("loud", 8000, 2, k, tone, tone), ("silent", 8000, 2, k, silent, silent)]
    out = rhythm.acoustic_vectors(signal.spectra(spark.createDataFrame(rows, schema), 32))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2  # the spectra and their measures
    got = by_path(out)
    assert set(got) == {"mixed", "loud"} and got["mixed"].vector == pytest.approx(got["loud"].vector)
