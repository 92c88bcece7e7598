"""WAV files by byte ranges, versioned tables, session reports and backends of frames."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import indexing, sessions, signal, store
from tessera.sources import reports, versions, wav
from tests.test_rhythm import RATE, clicks
from tests.test_rhythm import wav as pcm16


def chunked(form, data, extra=b"", extensible=False):
    """A WAV file of raw samples, with a further chunk of odd length before them."""
    code, channels, rate, bits = form
    width = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * width, width, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if extra:
        body += b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) % 2)
    body += b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    r = np.random.default_rng(8)
    x = r.uniform(-1, 1, (9001, 2))
    (root / "sub").mkdir()
    (root / "a.wav").write_bytes(pcm16(x))
    (root / "sub" / "b.WAV").write_bytes(pcm16(x[:700, :1]))
    whole = (x[:3000] * (1 << 23)).astype(np.int32)
    (root / "c24.wav").write_bytes(chunked((1, 2, 48000, 24), whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), b"odd"))
    (root / "f32.wav").write_bytes(chunked((3, 2, 44100, 32), x[:3000].astype("<f4").tobytes(), extensible=True))
    (root / "u8.wav").write_bytes(chunked((1, 1, 8000, 8), bytes(range(256)) * 4))
    (root / "early.wav").write_bytes(pcm16(x)[:-1001])
    (root / "bad.wav").write_bytes(b"RIFF but no WAVE")
    (root / "empty.wav").write_bytes(b"")
    (root / "note.txt").write_text("no audio")
    return str(root)


@pytest.fixture(scope="module")
def reader(spark):
    spark.dataSource.register(wav.WavFrames)
    return lambda path, **options: spark.read.format("wav_frames").options(**{k: str(v) for k, v in options.items()}).load(path)


def test_frames_are_the_same_however_files_are_cut(spark, reader, folder):
    files = spark.createDataFrame([(f"{folder}/a.wav", open(f"{folder}/a.wav", "rb").read())], "path string, content binary")
    key = lambda r: (r.path, r.frame)
    want = sorted(signal.frames(files, 256).collect(), key=key)
    all_ = None
    for split in (500, 4096, 10**9):
        got = sorted(reader(folder, size=256, split_bytes=split).collect(), key=key)
        assert all_ is None or got == all_
        all_ = got
    assert [r for r in all_ if r.path.endswith("/a.wav")] == want
    sizes = {}
    for r in all_:
        sizes[os.path.basename(r.path)] = sizes.get(os.path.basename(r.path), 0) + len(r.left)
        assert len(r.left) == len(r.right)
    assert sizes == {"a.wav": 9001, "b.WAV": 700, "c24.wav": 3000, "f32.wav": 3000, "u8.wav": 1024, "early.wav": 9001 - 251}
    x = np.random.default_rng(8).uniform(-1, 1, (9001, 2))
    for name in ("c24.wav", "f32.wav"):
        right = np.concatenate([r.right for r in all_ if r.path.endswith(name)])
        assert np.abs(right - x[:3000, 1]).max() < 1e-6
    assert reader(folder + "/a.wav", size=256).count() == 36


def test_headers_without_samples(reader, folder):
    got = {os.path.basename(r.path): tuple(r)[1:] for r in reader(folder, headers="true").collect()}
    assert got == {"a.wav": (8000, 2, 16, 9001), "b.WAV": (8000, 1, 16, 700), "c24.wav": (48000, 2, 24, 3000), "f32.wav": (44100, 2, 32, 3000), "u8.wav": (8000, 1, 8, 1024), "early.wav": (8000, 2, 16, 8750)}

    class Counting:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.bytes += n
            return self.file.read(n)

    with open(f"{folder}/a.wav", "rb") as f:
        counting = Counting(f)
        assert wav.header(counting, os.path.getsize(f"{folder}/a.wav")).samples == 9001 and counting.bytes < 100


def test_a_version_is_whole_or_not_there(spark, tmp_path):
    at = versions.Versions(spark, f"file://{tmp_path}/history")
    runs = lambda *rows: spark.createDataFrame(rows, "run_id string, track_id string, seq long")
    styles = lambda *rows: spark.createDataFrame(rows, "run_id string, label string, score double")
    tracks = spark.createDataFrame([("t1", "a", 1), ("t2", "b", 1)], "track_id string, name string, seq long")
    assert at.number() == 0 and at.read("runs") is None
    assert versions.record_runs(at, {"tracks": tracks, "runs": runs(("r1", "t1", 1), ("r2", "t2", 1)), "styles": styles(("r1", "x", 0.2), ("r1", "y", 0.7), ("r2", "z", 0.5))}) == 1
    new = {"runs": runs(("r1", "t1", 2), ("r3", "t1", 2)), "styles": styles(("r1", "w", 1.0), ("r3", "x", 0.1))}
    broken = dict(new, styles=new["styles"].withColumn("label", F.when(F.col("label") == "x", F.raise_error(F.lit("lost"))).otherwise(F.col("label"))))
    with pytest.raises(Exception, match="lost"):  # dies after runs were written, before styles are
        versions.record_runs(at, broken)
    assert at.number() == 1 and {r.run_id for r in at.read("runs").collect()} == {"r1", "r2"} and at.read("styles").count() == 3
    assert versions.record_runs(at, new) == 2
    assert {(r.run_id, r.seq) for r in at.read("runs").collect()} == {("r1", 2), ("r2", 1), ("r3", 2)}
    assert {(r.run_id, r.label, r["rank"]) for r in at.read("styles").collect()} == {("r1", "w", 1), ("r2", "z", 1), ("r3", "x", 1)}
    assert at.read("tracks").count() == 2 and at.read("styles", 1).count() == 3  # the version before stays readable
    with pytest.raises(versions.Conflict):
        at.commit({"runs": runs(("r9", "t9", 9))}, base=1)
    assert at.number() == 2 and at.read("runs").count() == 3


def test_reports_have_their_summaries(spark, tmp_path):
    schema = "status string, mode_severity string, history_severity string, history_comparable boolean, fast_genre string, auto_genre string, accurate_genre string, auto_windows int, accurate_windows int, input_quality string, duplicates int"
    rows = [("analyzed", "MINOR", "CRITICAL", True, "a", "a", "a", 3, 11, "NORMAL", 1), ("analyzed", None, None, False, None, "b", "a", 11, 11, "NORMAL", 0), ("error", "MINOR", None, False, "a", "a", "a", 1, 9, None, 0), ("skipped", None, None, True, None, None, None, None, None, None, 2)]
    outcomes = spark.createDataFrame(rows, schema)
    got = sessions.session_summary(outcomes).first()
    assert (got.scanned_tracks, got.analyzed_tracks, got.error_tracks, got.skipped_tracks, got.remaining_tracks, got.duplicate_paths) == (4, 2, 1, 1, 0, 3)
    assert (got.mode_minor, got.history_critical, got.severity_critical, got.severity_minor, got.history_not_comparable_tracks) == (1, 1, 1, 0, 1)
    assert (got.auto_vs_accurate_total, got.auto_vs_accurate_match_pct, got.fast_vs_accurate_match_pct) == (2, 50.0, 100.0)
    assert (got.saved_windows, got.saved_windows_pct, got.auto_early_stop_tracks, got.input_quality_counts) == (8, 36.36, 1, {"NORMAL": 2})
    empty = sessions.session_summary(outcomes.limit(0)).first()
    assert empty.scanned_tracks == 0 and empty.saved_windows_pct == 0 and empty.input_quality_counts == {}
    tracks = spark.createDataFrame([("t", "MINOR", ["a", "b"])], "track_id string, severity string, versions array<string>")
    path = reports.write_validation(tracks, outcomes, str(tmp_path), "12-34-5678-9")
    assert path.endswith("validation.12345678") and spark.read.json(f"{path}/summary.json").first().session_id == "12-34-5678-9"
    found = spark.read.option("header", "true").csv(f"{path}/rows.csv")
    assert found.columns == sessions.VALIDATION_COLUMNS and found.first().versions == "a; b"
    queries = spark.createDataFrame([(f"q{i}", "text", 0.5, 1.0, 1.0, 0.25, i / 10, i / 100, ["a", "b"]) for i in range(11)], "query_id string, query_type string, precision_at_k double, recall_at_k double, reciprocal_rank double, ndcg_at_k double, embedding_seconds double, ranking_seconds double, result_track_ids array<string>")
    path = reports.write_benchmark(queries, str(tmp_path), "my suite", "hash-16", 10)
    summary = spark.read.json(f"{path}/summary.json").first()
    assert (summary.embedding_p50, summary.ranking_p95, summary.mrr) == (0.5, 0.095, 1.0)
    text = "\n".join(r.value for r in spark.read.text(f"{path}/summary.md").collect())
    assert "# Retrieval benchmark: my suite" in text and "| precision_at_k | 0.500000 |" in text and "| paired_overlap_mean | N/A |" in text
    assert spark.read.option("header", "true").csv(f"{path}/rows.csv").first().result_track_ids == "a|b"
    pairs = spark.createDataFrame([("t", "p", "MINOR", "a", "a", "f", "g", "same", 0.1, 0.9)], "track_id string, path string, severity string, left_genre string, right_genre string, left_family string, right_family string, tempo_relation string, js_divergence double, cosine_similarity double")
    path = reports.write_version_comparison(pairs, str(tmp_path), "0.4/x", "0.5")
    assert path.endswith("version_compare.0.4_x_vs_0.5.all") and json.loads(spark.read.json(f"{path}/summary.json").toJSON().first())["genre_match_pct"] == 100


def test_files_are_embedded_once_and_intervals_are_cut(spark):
    t = np.arange(4 * RATE) / RATE
    tone = lambda f: 0.5 * np.sin(2 * np.pi * f * t)
    files = {"low": tone(200), "high": tone(2000), "both": np.where(t < 2, tone(200), tone(2000)), "click": clicks(120, 4), "silence": np.zeros(RATE)}
    framed = signal.frames(spark.createDataFrame([(p, pcm16(np.stack([x, x], 1))) for p, x in files.items()], "path string, content binary"), 512).cache()
    backend = indexing.AcousticBackend(128)
    catalog = spark.createDataFrame([(p,) for p in files], "item string")
    empty = spark.createDataFrame([], "key string, backend string, item string, vector array<float>")
    index = indexing.updated_frames(catalog, framed, empty, backend).cache()
    assert {r.item for r in index.collect()} == set(files) - {"silence"} and index.filter(F.size("vector") != 78).isEmpty()
    assert indexing.updated_frames(catalog.filter("item <> 'silence'"), framed, index, backend).count() == 0
    rows = index.select("backend", F.lit("full").alias("scope"), F.col("item").alias("track_id"), "vector")
    best = {}
    for start, end in ((0.2, 1.8), (2.2, 3.8)):
        query = indexing.interval_query(framed, 512, "both", start, end, backend)
        best[start] = store.interval_search(rows, backend.name, query, start, end, track="both", k=1).first().track_id
    assert best == {0.2: "low", 2.2: "high"}
    assert indexing.interval_query(framed, 512, "silence", 0, 1, backend) is None
    with pytest.raises(ValueError):
        indexing.interval_query(framed, 512, "both", 1, 1.5, backend)


def test_tags_of_windows(spark):
    rows = [("a", l, w * x) for w in (1, 3) for l, x in (("x", 1.0), ("y", -1.0), ("z", 1.0))] + [("b", "x", 0.0)]
    got = [tuple(r) for r in indexing.window_tags(spark.createDataFrame(rows, "item string, label string, logit double"), most=2).orderBy("item", "rank").collect()]
    mean = round((1 / (1 + np.exp(-1)) + 1 / (1 + np.exp(-3))) / 2, 6)
    assert got == [("a", 1, "z", mean), ("a", 2, "x", mean), ("b", 1, "x", 0.5)]
