import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import indexing, signal

RATE = 8000


def wav(*channels, width=2):
    x = np.stack(channels, axis=1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(width), w.setframerate(RATE)
        v = np.clip(np.round(x * ((1 << (8 * width - 1)) - 1)), -(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1).astype("<i4")
        w.writeframes(v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


@pytest.fixture(scope="module")
def framed(spark):
    t = np.arange(2 * RATE) / RATE
    tone = 0.5 * np.sin(2 * np.pi * 440 * t)
    chord = sum(0.2 * np.sin(2 * np.pi * f * t) for f in (261.63, 329.63, 392.0, 523.25))
    rows = [("mono", wav(tone)), ("wide", wav(tone, -tone)), ("deep", wav(tone, tone, width=3)), ("chord", wav(chord)), ("silence", wav(0 * t)), ("broken", b"no wave")]
    return signal.frames(spark.createDataFrame(rows, "path string, content binary"), 1024)


def test_levels(framed):
    got = {r.path: r for r in signal.levels(framed).withColumn("verdict", signal.retention_verdict(F.col("mono_retention_db"))).collect()}
    assert set(got) == {"mono", "wide", "deep", "chord", "silence"}
    assert got["mono"].seconds == 2 and math.isclose(got["mono"].rms, 0.5 / math.sqrt(2), rel_tol=1e-3) and got["mono"].verdict == "PASS"
    assert math.isclose(got["deep"].correlation, 1, rel_tol=1e-6) and math.isclose(got["wide"].correlation, -1, rel_tol=1e-3)
    assert got["wide"].verdict == "FAIL" and got["silence"].verdict == "UNKNOWN" and got["silence"].correlation is None
    assert math.isclose(got["mono"].sign_change_rate, 880 / RATE, rel_tol=0.05)


def test_spectrum_and_key(framed):
    s = signal.spectra(framed)
    shape = {r.path: r for r in signal.spectral_shape(s).collect()}
    assert abs(shape["mono"].centroid_hz - 440) < 30 and abs(shape["mono"].rolloff_hz - 440) < 40 and "silence" not in shape
    key = {r.path: (r.key, r.mode) for r in signal.estimate_key(signal.chroma(s)).collect()}
    assert key["chord"] == ("C", "major")


def test_second_run_embeds_nothing(spark, tmp_path):
    catalog = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "item string, payload string")
    index = spark.createDataFrame([("k", "other", "a", [1.0])], "key string, backend string, item string, vector array<float>")
    first = indexing.updated(catalog, index, indexing.HashBackend)
    first.write.parquet(str(tmp_path / "i"))
    index = index.union(spark.read.parquet(str(tmp_path / "i")))
    assert {r.item for r in index.filter("backend = 'hash-16'").collect()} == {"a", "b"}
    assert indexing.updated(catalog, index, indexing.HashBackend).count() == 0
    assert indexing.run_report(catalog, index, "hash-16").first().asDict() == {"catalog_rows": 3, "hits": 2, "misses": 1, "stale_rows": 1}
