"""Filters over frames, alignment, comparison of two files, and the temporal profile."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import comparison, filters, rhythm, signal, structure
from tests.test_rhythm import RATE, SIZE, by_path, clicks, wav


def framed(spark, files, size=SIZE, rate=RATE):
    rows = [(p, wav(np.stack(x if isinstance(x, tuple) else (x, x), 1), rate)) for p, x in files.items()]
    return signal.frames(spark.createDataFrame(rows, "path string, content binary"), size)


def whole(df, path, side="left"):
    return np.concatenate([np.asarray(r[side], np.float64) for r in df.filter(F.col("path") == path).orderBy("frame").collect()])


def test_the_band_pass_has_its_corners():
    for rate, low, high in ((8000, 35.0, 3600.0), (48000, 35.0, 12000.0), (44100, 300.0, 3000.0)):
        a, b, c, d = filters.band_pass(rate, low, high)
        gain = lambda f: abs(d + c @ np.linalg.solve(np.exp(2j * np.pi * f / rate) * np.eye(len(a)) - a, b))  # noqa: B023, E731
        assert gain(low) == pytest.approx(math.sqrt(0.5), rel=1e-6) and gain(high) == pytest.approx(math.sqrt(0.5), rel=1e-6)
        assert gain(math.sqrt(low * high)) == pytest.approx(1, abs=1e-3) and gain(low / 10) < 0.002 and max(abs(np.linalg.eigvals(a))) < 1


@pytest.mark.parametrize("size, block", [(40, 2), (512, 3), (5000, 1024)])
def test_the_filter_equals_a_plain_recursion(spark, size, block):
    r = np.random.default_rng(4)
    files = {"a": 0.3 * r.normal(size=6011), "b": np.sin(np.arange(700) / 9) * 0.5, "one": np.array([0.25])}
    rows = framed(spark, files, size)
    got = filters.filtered(rows, block=block).cache()
    a, b, c, d = filters.band_pass(RATE, 35.0, 0.45 * RATE)
    for path in files:
        x, state, want = whole(rows, path), np.zeros(len(b)), []
        for v in x:
            want.append(c @ state + d * v)
            state = a @ state + b * v
        assert np.abs(whole(got, path) - want).max() < 1e-9
    assert filters.filtered(rows.limit(0)).count() == 0


def test_windows_and_shifts_cross_frames(spark):
    x = np.arange(1, 2001) / 4000
    rows = framed(spark, {"a": (x, -x)}, 128)
    full = whole(rows, "a")
    cut = filters.windows_of(rows, 128, spark.createDataFrame([("a", 1, 100, 300), ("a", 2, 0, 1), ("a", 3, 1990, 50), ("a", 4, 128, 128), ("a", 5, 5000, 9), ("a", 6, -1, 9)], "path string, w long, start long, length long"))
    got = {r.w: r for r in cut.collect()}
    assert set(got) == {1, 2, 3, 4}
    for w, (s, n) in {1: (100, 300), 2: (0, 1), 3: (1990, 50), 4: (128, 128)}.items():
        assert np.array_equal(np.asarray(got[w].left), full[s : s + n]) and np.array_equal(got[w].left, [-v for v in got[w].right])
    for start, count in ((0, 2000), (1, 1999), (127, 300), (128, 256), (500, 1)):
        out = filters.shifted(rows, 128, spark.createDataFrame([("a", start, count)], "path string, start long, count long"))
        sizes = [len(r.left) for r in out.orderBy("frame").collect()]
        assert np.array_equal(whole(out, "a"), full[start : start + count]) and all(n == 128 for n in sizes[:-1])


def test_a_shifted_and_scaled_copy_is_found(spark):
    r = np.random.default_rng(2)
    a = clicks(120, 12) * np.repeat(r.uniform(0.5, 1, 24), RATE // 2) + 0.002 * r.normal(size=12 * RATE)
    late, early = np.concatenate([np.zeros(400), a]), a[240:]
    rows = {"late": a, "early": a, "loss": a, "soft": a, "apart": a}
    soft = a.copy()
    for k in range(24):
        soft[int(k * RATE / 2) : int(k * RATE / 2) + 320] *= 0.7
    others = {"late": 0.5 * late, "early": 0.5 * early, "loss": (0.5 * late, -0.5 * late), "soft": soft, "missing": a}
    got = by_path(comparison.compared(framed(spark, rows), framed(spark, others), SIZE))
    assert set(got) == {"late", "early", "loss", "soft"}
    for path, lag in (("late", 400), ("early", -240)):
        g = got[path]
        assert g.lag_samples == lag and g.lag_ms == lag / 8 and g.correlation > 0.9
        assert g.gain_db == pytest.approx(20 * math.log10(2), abs=0.01) and g.residual_db < -60
        assert 18 <= g.events_used <= 64 and g.events_used <= g.events_detected and abs(g.guard) < 0.02
        assert (g.attack_status, g.mono_status, g.overall_status) == ("PASS", "PASS", "PASS")
    assert got["loss"].mono_status == "FAIL" == got["loss"].overall_status and got["loss"].worst_delta < -100
    assert got["soft"].attack_status == "FAIL" and got["soft"].guard < -1.5 and got["soft"].mono_status == "PASS"


def test_attacks_are_measured_by_the_sample(spark):
    event = RATE // 2
    x, y = np.zeros(RATE), np.zeros(RATE)
    for out, attack in ((x, 0.8), (y, 0.4)):
        out[event - 40 : event + 280], out[event + 360 : event + 1160] = attack, 0.2
    at = spark.createDataFrame([("p", 1, event, RATE), ("p", 2, 20, RATE), ("p", 3, RATE - 100, RATE)], "path string, w long, sample long, rate int")
    deltas = comparison.attack_deltas(framed(spark, {"p": x}), framed(spark, {"p": y}), SIZE, at).collect()
    assert len(deltas) == 1  # the others lack samples before or after
    half = 20 * math.log10(0.5)
    assert deltas[0].rms_delta == pytest.approx(half, abs=0.01) and deltas[0].contrast_delta == pytest.approx(half, abs=0.01)
    guard = comparison.retention(spark.createDataFrame(deltas)).first()
    assert guard.events_used == 1 and guard.guard == pytest.approx(half, abs=0.01)


def test_mono_loss_by_band(spark):
    rate, t = 48000, np.arange(3 * 48000) / 48000
    files = {str(f): (0.4 * np.sin(2 * np.pi * f * t), 0.2 * np.sin(2 * np.pi * f * t)) for f in (60, 250, 1000, 9000)}
    rows = framed(spark, files, 4096, rate)
    got = {(r.path, r.band): r.retention_db for r in filters.welch_retention(rows, 4096).collect()}
    for f, band in ((60, "low_20_120"), (250, "low_mid_120_500"), (1000, "presence_500_4000"), (9000, "high_4000_18000")):
        assert got[str(f), band] == pytest.approx(10 * math.log10(0.5625 / 0.625), abs=0.1)
    one = signal.frames(spark.createDataFrame([("m", wav(np.zeros((9000, 1))))], "path string, content binary"), SIZE)
    assert filters.welch_retention(one, SIZE).count() == 0 and comparison.mono_deltas(one, one, SIZE).count() == 0


def test_peaks_are_apart_and_prominent():
    r = np.random.default_rng(5)
    for _ in range(50):
        x = r.integers(0, 9, 60).astype(float)
        at = [i for i in range(1, 59) if x[i] > x[i - 1] and x[i] >= x[i + 1]]
        if not at:
            continue
        edges = [0, *at, 59]
        valley = np.array([x[a : b + 1].min() for a, b in zip(edges[:-1], edges[1:])])
        want = []
        for i in at:
            left = next((k for k in range(i, -1, -1) if x[k] > x[i]), -1)
            right = next((k for k in range(i, 60) if x[k] > x[i]), 60)
            want.append(x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min()))
        assert rhythm.prominences(x[at], valley).tolist() == want
    assert rhythm.apart(np.array([0, 80, 160, 300]), np.array([10.0, 9.0, 8.0, 1.0]), 85).tolist() == [True, False, True, True]


@pytest.mark.parametrize("bpm", [60, 77.3, 96.7, 120, 133.3, 160])
def test_tempo_within_a_tenth(spark, bpm):
    rows = framed(spark, {"a": clicks(bpm, 20)}, 128)
    assert abs(rhythm.tempo(rhythm.onset_strength(signal.spectra(rows, 32)), RATE / 128).first().bpm - bpm) < 0.1


def test_a_profile_for_each_file(spark):
    jitter = np.zeros(10 * RATE)
    burst = clicks(60, 1)[: RATE // 10]
    for k, late in enumerate(np.random.default_rng(3).integers(-500, 500, 18)):
        jitter[4000 * (k + 1) + late :][: len(burst)] += burst * (0.4 + 0.6 * (k % 2))
    rows = framed(spark, {"even": clicks(120, 10), "jitter": jitter, "silence": np.zeros(3 * RATE)}, 128)
    got = by_path(structure.profile(rows, 128, RATE, 64))
    assert set(got) == {"even", "jitter", "silence"} and all(g.status == "OK" for g in got.values())
    even, other, silence = got["even"], got["jitter"], got["silence"]
    assert even.duration_s == 10 and even.transients.attack_similarity_median > 0.99 and even.transients.attack_similarity_p95 > 0.99
    assert other.rhythm.gap_cv > even.rhythm.gap_cv and other.transients.attack_energy_cv > even.transients.attack_energy_cv + 0.1
    assert silence.rhythm.onset_count == 0 == silence.transients.transient_count and silence.transients.attack_similarity_median is None and silence.rhythm.tempo_bpm is None


def test_attack_pairs_are_exact(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(40, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [("p", i, x.tolist(), 1.0, 2.0) for i, x in enumerate(v)] + [("q", 0, v[0].tolist(), 1.0, 2.0), ("same", 0, v[0].tolist(), 1.0, 2.0), ("same", 1, v[0].tolist(), 1.0, 2.0)]
    got = by_path(structure.attack_summary(spark.createDataFrame(rows, "path string, w long, vector array<double>, level double, peak_ms double")))
    pairs = [float(v[i] @ v[j]) for i in range(40) for j in range(i)]
    assert got["p"].attack_similarity_median == pytest.approx(np.median(pairs)) and got["p"].attack_similarity_p95 == pytest.approx(np.percentile(pairs, 95))
    assert got["q"].attack_similarity_median is None and got["q"].transient_count == 1 and got["same"].attack_similarity_p95 == pytest.approx(1)
