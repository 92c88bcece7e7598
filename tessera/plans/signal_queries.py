"""Queries of the audio operators. Vectors stand for frames: sixteen rows of ``embeddings`` are a
file of 64 samples a frame, and each vector, or the values of a user's events, a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import comparison, filters, rhythm, signal, structure
from tessera.sources.tables import load

SIZE = 64


def frames_of(spark, d, rate: int = 8000) -> DataFrame:
    other = F.transform("embedding", lambda x, i: (x.cast("double") * (i % 3 - 0.5)).cast("float"))
    path, frame = F.expr("cast(vec_id div 16 as string)"), F.col("vec_id") % 16
    return load(spark, d, "embeddings").select(path.alias("path"), F.lit(rate).alias("rate"), F.lit(2).alias("channels"), frame.alias("frame"), F.col("embedding").alias("left"), other.alias("right"))


def series_of(spark, d) -> DataFrame:
    """``path, t, value, power`` of each user's events in the order of time."""
    e = load(spark, d, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("path"), t.cast("long").alias("t"), "value", (F.col("value") * F.col("value")).alias("power"))


def vectors_of(spark, d) -> DataFrame:
    """``path, t, residual`` of each vector's members."""
    return load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.posexplode("embedding").alias("t", "x")).select("path", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("residual"))


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def signal_levels(spark, d):
    """Level, peak, active level, correlation of the sides, mono retention and its verdict, and sign changes of each file."""
    rows = signal.levels(frames_of(spark, d)).withColumn("verdict", signal.retention_verdict(F.col("mono_retention_db")))
    return _round(rows, 5, "seconds", "rms", "peak", "active_rms", "correlation", "mono_retention_db", "sign_change_rate")


def aligned_overlap(spark, d):
    """What two copies have in common where one is later by -65 to 64 samples: frames, samples and how far they differ."""
    f = frames_of(spark, d)
    lag = f.select("path").distinct().withColumn("lag_samples", F.col("path").cast("long") % 130 - 65)
    a, b = comparison.aligned(f, f, SIZE, lag)
    sizes = a.groupBy("path").agg(F.count("*").alias("frames"), F.sum(F.size("left")).alias("samples"))
    return _round(sizes.join(comparison.residual(a, b), "path"), 5, "residual_db")


def attack_retention(spark, d):
    """How attacks at three places of each file come through in a copy whose odd frames are quieter, and the verdict."""
    f = frames_of(spark, d, 2000)
    quiet = lambda c: F.transform(c, lambda x: (x.cast("double") / (1 + F.col("frame") % 2)).cast("float")).alias(c)
    copy = f.select("path", "rate", "channels", "frame", quiet("left"), quiet("right"))
    event = f.select("path", "rate").distinct().withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("sample", (F.col("w") * 200 + F.col("path").cast("long") % 50))
    found = comparison.retention(comparison.attack_deltas(f, copy, SIZE, event))
    return _round(found, 5, "rms_delta", "contrast_delta", "guard").withColumn("status", comparison.verdict(F.col("guard"), comparison.ATTACK_WARN, comparison.ATTACK_FAIL, "FAIL"))


def band_passed_frames(spark, d):
    """The power of each frame after the band-pass, and its last sample."""
    out = filters.filtered(frames_of(spark, d), block=4)
    return out.select("path", "frame", F.round(F.aggregate("left", F.lit(0.0), lambda s, x: s + x * x), 5).alias("power"), F.round(F.element_at("left", -1), 5).alias("last"))


def window_peaks(spark, d):
    """The greatest sample of overlapping windows that cross frames."""
    f = frames_of(spark, d)
    windows = f.select("path").distinct().withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("path", "w", (F.col("w") * 100 + 7).alias("start"), F.lit(150).alias("length"))
    return filters.windows_of(f, SIZE, windows).select("path", "w", F.size("left").alias("samples"), F.round(F.array_max("left").cast("double"), 6).alias("peak"))


def spectral_shapes(spark, d):
    return _round(signal.spectral_shape(signal.spectra(frames_of(spark, d), 32)), 3, "centroid_hz", "rolloff_hz")


def onset_strengths(spark, d):
    """How much the frames' spectra rise, by file."""
    rows = rhythm.onset_strength(signal.spectra(frames_of(spark, d), 32))
    return rows.groupBy("path").agg(F.count("*").alias("frames"), F.round(F.sum("value"), 4).alias("rise"), F.max_by("t", "value").alias("at"))


def smoothed_series(spark, d):
    """Centred means of five values, and what rises above the median of five."""
    s = rhythm.without_baseline(rhythm.moving_average(series_of(spark, d), 5), 5)
    return s.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum("smooth"), 4).alias("smooth"), F.round(F.sum(F.abs("residual")), 4).alias("residual"))


def active_levels(spark, d):
    """The level of windows of four values, every second, that are near the loudest."""
    return _round(rhythm.active_level(series_of(spark, d), wide=4, hop=2, gate_db=-6.0), 6, "level")


def vector_peaks(spark, d):
    """The five most prominent peaks of each vector."""
    return _round(rhythm.prominent_peaks(vectors_of(spark, d), least=0.1, most=5), 6, "prominence")


def interval_cuts(spark, d):
    """The frames of a time interval, cut to it."""
    cut = rhythm.interval(frames_of(spark, d), SIZE, 0.01, 0.1)
    return cut.groupBy("path").agg(F.count("*").alias("frames"), F.sum(F.size("left")).alias("samples"), F.round(F.sum(F.aggregate("left", F.lit(0.0), lambda s, x: s + x)), 5).alias("total"))


def gaps_of_events(spark, d):
    """The variation of each user's gaps and values, as of onsets."""
    s = series_of(spark, d).withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("path").orderBy("t")))
    return s.groupBy("path").agg(F.round(rhythm.variation(F.col("value")), 6).alias("value_cv"), F.round(rhythm.variation(F.abs("step")), 6).alias("step_cv"))


def file_levels_equal(spark, d):
    """Files at one level: what scales each, and its level then."""
    f = frames_of(spark, d)
    return _round(signal.levels(rhythm.at_level(f, 0.1)).join(signal.levels(f).select("path", F.col("rms").alias("before")), "path").select("path", "rms", "before"), 5, "rms", "before")


def mastering_comparison(spark, d):
    """Each file of frames against a copy that is 37 samples later and half as loud, from lag to verdict."""
    f = frames_of(spark, d)
    half = lambda c: F.transform(c, lambda x: (x * 0.5).cast("float")).alias(c)
    last = filters.samples(f).select("path", F.lit(37).alias("start"), (F.col("samples") - 37).alias("count"))
    return comparison.compared(filters.shifted(f, SIZE, last), f.select("path", "rate", "channels", "frame", half("left"), half("right")), SIZE, max_lag_s=0.05)


def temporal_profiles(spark, d):
    """Cepstra, rhythm, attacks and spectral peaks of each file of frames."""
    rows = structure.profile(frames_of(spark, d), SIZE, 8000, 32)
    return rows.select("path", "sample_rate_hz", "duration_s", "status", *(F.to_json(c).alias(c) for c in ("mfcc", "rhythm", "transients", "spectral_artifacts")))


def acoustic_vectors(spark, d):
    return rhythm.acoustic_vectors(signal.spectra(frames_of(spark, d), 32)).select("path", F.size("vector").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        signal_levels, aligned_overlap, attack_retention, band_passed_frames, window_peaks, spectral_shapes, onset_strengths, smoothed_series, active_levels, vector_peaks, interval_cuts, gaps_of_events, file_levels_equal,
        mastering_comparison, temporal_profiles, acoustic_vectors,
    )
}

_SAMPLES = """s AS (
  SELECT (vec_id // 16)::VARCHAR AS path, vec_id % 16 AS frame, i, (vec_id % 16) * 64 + i AS t, x::DOUBLE AS l, y::DOUBLE AS r, (x + y)::DOUBLE / 2 AS m FROM (
    SELECT vec_id, i, embedding[i + 1]::FLOAT AS x, (embedding[i + 1]::DOUBLE * (i % 3 - 0.5::DOUBLE))::FLOAT AS y FROM embeddings, (SELECT unnest(range(64)) AS i))
)"""
_SPECTRA = f"""{_SAMPLES}, w AS (
  SELECT path, frame, i, (l + r) / 2 * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63)) AS x FROM s
), z AS (
  SELECT path, frame, k, sum(x * cos(2 * pi() * i * k / 64)) AS a, sum(x * sin(2 * pi() * i * k / 64)) AS b FROM w, (SELECT unnest(range(1, 33)) AS k) GROUP BY ALL
), p AS (
  SELECT path, frame, k - 1 AS band, a * a + b * b AS p FROM z
)"""


def _band_pass_sql() -> str:
    a, b, c, d = filters.band_pass(8000, 35.0, 3600.0)
    names = [f"x{i}" for i in range(len(b))]
    linear = lambda row: " + ".join(f"({v!r}::DOUBLE) * {n}" for v, n in zip((float(v) for v in row), names) if v) or "0::DOUBLE"
    step = ", ".join(f"{linear(a[i])} + ({float(b[i])!r}::DOUBLE) * ((l + r) / 2)" for i in range(len(b)))
    return f"""WITH RECURSIVE {_SAMPLES}, f AS (
  SELECT path, -1::BIGINT AS t, {", ".join(f"0::DOUBLE AS {n}" for n in names)}, 0::DOUBLE AS y FROM s WHERE t = 0
  UNION ALL SELECT s.path, s.t, {step}, {linear(c)} + ({float(d)!r}::DOUBLE) * ((l + r) / 2) FROM f JOIN s ON s.path = f.path AND s.t = f.t + 1
)
SELECT path, t // 64 AS frame, round(sum(y * y), 5) AS power, round(arg_max(y, t), 5) AS last FROM f WHERE t >= 0 GROUP BY ALL"""


_SERIES = "e AS (SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, value * value AS power FROM events)"
_CV = "CASE WHEN count({0}) < 2 THEN NULL WHEN abs(avg({0})) > 1e-12 THEN stddev_pop({0}) / abs(avg({0})) WHEN max(abs({0})) <= 1e-8 THEN 0 END"
SQL = {
    "signal_levels": f"""WITH {_SAMPLES}, c AS (SELECT *, (l >= 0) <> (lag(l) OVER (PARTITION BY path, frame ORDER BY i) >= 0) AS crossed FROM s),
        f AS (SELECT path, frame, count(*) AS n, sum(l * l) AS ll, sum(r * r) AS rr, sum(m * m) AS mm, sum(l * r) AS lr, max(greatest(abs(l), abs(r))) AS peak, count(*) FILTER (crossed) AS crossings FROM c GROUP BY ALL),
        g AS (SELECT *, (ll + rr) / 2 / n AS p, (ll + rr) / 2 / n >= max((ll + rr) / 2 / n) OVER (PARTITION BY path) * 1e-3 AS active FROM f),
        o AS (SELECT path, sum(n) / 8000::DOUBLE AS seconds, sqrt(sum(mm) / sum(n)) AS rms, max(peak) AS peak, sqrt(sum(p * n) FILTER (active) / sum(n) FILTER (active)) AS active_rms,
              CASE WHEN sum(ll) * sum(rr) > 0 THEN sum(lr) / sqrt(sum(ll) * sum(rr)) END AS correlation, 10 * log10(greatest(sum(mm), 1e-30) / ((sum(ll) + sum(rr)) / 2)) AS db, sum(crossings) / (sum(n) - count(*)) AS rate FROM g GROUP BY path)
        SELECT path, round(seconds, 5) AS seconds, round(rms, 5) AS rms, round(peak, 5) AS peak, round(active_rms, 5) AS active_rms, round(correlation, 5) AS correlation, round(db, 5) AS mono_retention_db, round(rate, 5) AS sign_change_rate,
        CASE WHEN db IS NULL THEN 'UNKNOWN' WHEN db <= -1.5 THEN 'FAIL' WHEN db <= -0.5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM o""",
    "aligned_overlap": f"""WITH {_SAMPLES}, n AS (SELECT path, count(*) AS n, path::BIGINT % 130 - 65 AS lag FROM s GROUP BY path), k AS (SELECT path, lag, n - abs(lag) AS samples FROM n WHERE n > abs(lag)),
        j AS (SELECT a.path, a.t - greatest(-lag, 0) AS t, (a.l - b.l) * (a.l - b.l) + (a.r - b.r) * (a.r - b.r) AS d, a.l * a.l + a.r * a.r AS p FROM k JOIN s a ON a.path = k.path JOIN s b ON b.path = a.path AND b.t = a.t + lag)
        SELECT path, (max(t) // 64) + 1 AS frames, count(*) AS samples, round(CASE WHEN sum(p) > 0 THEN 10 * log10(greatest(sum(d) / sum(p), 1e-30)) END, 5) AS residual_db FROM j GROUP BY path""",
    "attack_retention": f"""WITH {_SAMPLES}, n AS (SELECT path, max(t) + 1 AS n FROM s GROUP BY path), v AS (SELECT path, w, w * 200 + path::BIGINT % 50 AS ev FROM n, (SELECT unnest(range(1, 4)) AS w) WHERE w * 200 + path::BIGINT % 50 + 290 <= n),
        b AS (SELECT s.path, w, t - ev AS k, l, r, (l / (1 + frame % 2))::FLOAT::DOUBLE AS l2, (r / (1 + frame % 2))::FLOAT::DOUBLE AS r2 FROM v JOIN s ON s.path = v.path AND t BETWEEN ev - 10 AND ev + 289),
        m AS (SELECT path, w, 20 * log10(max(greatest(abs(l), abs(r))) FILTER (k < 70)) AS p1, 20 * log10(max(greatest(abs(l2), abs(r2))) FILTER (k < 70)) AS p2,
              10 * log10(sum(l * l + r * r) FILTER (k < 70) / 160) AS a1, 10 * log10(sum(l2 * l2 + r2 * r2) FILTER (k < 70) / 160) AS a2, 10 * log10(sum(l * l + r * r) FILTER (k >= 90) / 400) AS s1, 10 * log10(sum(l2 * l2 + r2 * r2) FILTER (k >= 90) / 400) AS s2 FROM b GROUP BY ALL),
        g AS (SELECT path, count(*) AS events_used, quantile_cont(a2 - a1, 0.5) AS rms_delta, quantile_cont((p2 - p1) - (s2 - s1), 0.5) AS contrast_delta FROM m GROUP BY path)
        SELECT path, events_used, round(rms_delta, 5) AS rms_delta, round(contrast_delta, 5) AS contrast_delta, round(least(rms_delta, contrast_delta), 5) AS guard,
        CASE WHEN least(rms_delta, contrast_delta) < -1.5 THEN 'FAIL' WHEN least(rms_delta, contrast_delta) < -0.75 THEN 'WARN' ELSE 'PASS' END AS status FROM g""",
    "band_passed_frames": _band_pass_sql(),
    "window_peaks": f"""WITH {_SAMPLES} SELECT path, w::INT AS w, count(*)::INT AS samples, round(max(l), 6) AS peak FROM s JOIN (SELECT unnest(range(10)) AS w) ON t BETWEEN w * 100 + 7 AND w * 100 + 156 GROUP BY ALL""",
    "spectral_shapes": f"""WITH {_SPECTRA}, b AS (SELECT path, band, sum(p) AS p FROM p GROUP BY ALL), h AS (SELECT path, p, (band + 0.5::DOUBLE) * 8000 / 2 / 31 AS hz, sum(p) OVER (PARTITION BY path ORDER BY band) AS run, sum(p) OVER (PARTITION BY path) AS whole FROM b)
        SELECT path, round(sum(hz * p) / sum(p), 3) AS centroid_hz, round(min(hz) FILTER (run >= 0.85::DOUBLE * whole), 3) AS rolloff_hz FROM h WHERE whole > 0 GROUP BY path""",
    "onset_strengths": f"""WITH {_SPECTRA}, d AS (SELECT path, frame, 10 * log10(greatest(p, 1e-10)) - lag(10 * log10(greatest(p, 1e-10))) OVER (PARTITION BY path, band ORDER BY frame) AS rise FROM p),
        f AS (SELECT path, frame, coalesce(sum(greatest(rise, 0)), 0) / 32 AS v FROM d GROUP BY ALL) SELECT path, count(*) AS frames, round(sum(v), 4) AS rise, arg_max(frame, v) AS at FROM f GROUP BY path""",
    "smoothed_series": f"""WITH {_SERIES}, w AS (SELECT path, value, avg(value) OVER v AS smooth, quantile_cont(value, 0.5) OVER v AS middle FROM e WINDOW v AS (PARTITION BY path ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
        SELECT path, count(*) AS n, round(sum(smooth), 4) AS smooth, round(sum(abs(value - middle)), 4) AS residual FROM w GROUP BY path""",
    "active_levels": f"""WITH {_SERIES}, w AS (SELECT path, t, count(*) OVER v AS n, avg(power) OVER v AS p, count(*) OVER (PARTITION BY path) AS total FROM e WINDOW v AS (PARTITION BY path ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        k AS (SELECT path, p, max(p) OVER (PARTITION BY path) AS loudest FROM w WHERE t % 2 = 0 AND (n = 4 OR (total < 4 AND t = 0))) SELECT path, round(sqrt(avg(p)), 6) AS level FROM k WHERE p >= loudest * pow(10::DOUBLE, -0.6::DOUBLE) GROUP BY path""",
    "vector_peaks": """WITH v AS (SELECT vec_id::VARCHAR AS path, i AS t, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i)),
        p AS (SELECT * FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM v WINDOW w AS (PARTITION BY path ORDER BY t)) WHERE x > a AND x >= b),
        e AS (SELECT p.path, p.t, p.x, coalesce(max(v.t) FILTER (v.t < p.t AND v.x > p.x), 0) AS lo, coalesce(min(v.t) FILTER (v.t > p.t AND v.x > p.x), 63) AS hi FROM p JOIN v USING (path) GROUP BY ALL),
        r AS (SELECT e.path, e.t, e.x - greatest(min(v.x) FILTER (v.t BETWEEN lo AND e.t), min(v.x) FILTER (v.t BETWEEN e.t AND hi)) AS rise FROM e JOIN v USING (path) GROUP BY e.path, e.t, e.x),
        k AS (SELECT *, count(*) OVER (PARTITION BY path) AS peaks, row_number() OVER (PARTITION BY path ORDER BY rise DESC, t) AS rn FROM r WHERE rise >= 0.1::DOUBLE)
        SELECT path, t, round(rise, 6) AS prominence, peaks FROM k WHERE rn <= 5""",
    "interval_cuts": f"WITH {_SAMPLES} SELECT path, count(DISTINCT frame) AS frames, count(*) AS samples, round(sum(l), 5) AS total FROM s WHERE t >= 80 AND t < 800 GROUP BY path",
    "gaps_of_events": f"WITH {_SERIES}, d AS (SELECT path, value, abs(value - lag(value) OVER (PARTITION BY path ORDER BY t)) AS step FROM e) SELECT path, round({_CV.format('value')}, 6) AS value_cv, round({_CV.format('step')}, 6) AS step_cv FROM d GROUP BY path",
    "file_levels_equal": f"WITH {_SAMPLES} SELECT path, 0.1::DOUBLE AS rms, round(sqrt(avg(m * m)), 5) AS before FROM s GROUP BY path HAVING sqrt(avg(m * m)) >= 1e-4",
}
