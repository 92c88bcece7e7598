import base64
import json
import struct

from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import events


def test_results_and_broken_files(spark, tmp_path):
    good = {"path": "a.wav", "audio_features": {"bpm": 120.0, "key": "B", "mode": "minor"}, "top_styles": [{"label": "Pop---Ballad", "score": 0.5}]}
    for name, text in (("a.json", json.dumps(good)), ("b.json", "{not json"), ("c.json", '{"path": "x"}')):
        (tmp_path / name).write_text(text)
    rows, bad = files.results(spark, str(tmp_path))
    r = rows.collect()
    assert len(r) == 1 and r[0].audio_features.bpm == 120.0 and len(r[0].run_id) == 64
    assert {x.file.rsplit("/", 1)[1] for x in bad.collect()} == {"b.json", "c.json"}


def test_suite(spark, tmp_path):
    queries = [{"query_id": "q", "query_type": "text", "relevance": {"a": 3, "b": 9}}]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "name": "n", "queries": queries}))
    q, g = files.suite(spark, str(tmp_path))
    assert q.count() == 1 and [(r.id, r.grade) for r in g.collect()] == [("a", 3)]


def test_vectors_from_text(spark):
    values = [1.0, -0.5, 0.0, 3.1415927410125732, 1e-40, 65504.25]
    text = base64.b64encode(struct.pack("<6f", *values)).decode()
    got = spark.createDataFrame([(text,), ("",)], "v string").select(files.float_array("v").alias("x")).collect()
    assert list(got[0].x) == list(struct.unpack("<6f", struct.pack("<6f", *values))) and got[1].x == []


def test_audio_files_and_contents(spark, tmp_path):
    for name in ("a.WAV", "b.txt", ".git/c.wav", "d/e.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"same")
    assert {r.path.rsplit("/", 1)[1] for r in files.audio_files(spark, str(tmp_path)).collect()} == {"a.WAV", "e.flac"}
    assert {r.track_id for r in files.content_ids(spark, str(tmp_path)).collect()} == {"sha256:0967115f2813a3541eaef77de9d9d5773f1c0c04314b0bbfe4ff3b3b1c55b5d5"}


def test_preset_and_telemetry(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<Root><Param ElementID="E" ParamID="P" Value="1.5"/><Param ElementID="E" ParamID="Q" Value="x"/></Root>')
    assert {(r.param, r.value) for r in files.parameters(spark, str(tmp_path / "p.xml")).collect()} == {("P", "1.5"), ("Q", "x")}
    (tmp_path / "t.csv").write_text("12 %, 300 MiB\nN/A, [N/A]\n")
    assert [tuple(r) for r in files.telemetry(spark, str(tmp_path / "t.csv"), ["load", "memory"]).collect()] == [(12.0, 300.0), (None, None)]


def test_flat_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, tags array<string>")
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).first().tags == "a; b"


def split_events(spark, data, tmp_path, n=4):
    e = spark.read.parquet(f"{data}/events.parquet")
    for i in range(n):
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, e.schema.simpleString()[7:-1].replace(":", " ")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_windows_equal_the_batch(spark, data, tmp_path):
    table, schema = split_events(spark, data, tmp_path)
    stream = lambda: events.read_events(spark, str(tmp_path / "in"), schema, 1)
    batch = table.withColumn("ts", F.col("ts").cast("timestamp"))
    for size, hop in (("1 hour", None), ("1 hour", "30 minutes")):
        got = run(events.windows(stream(), ["event_type"], size=size, hop=hop, late="3650 days"), f"w{hop is None}", "complete")
        want = events.windows(batch, ["event_type"], size=size, hop=hop, late="3650 days")
        key = lambda d: sorted((r.start, r.event_type, r.n) for r in d.collect())
        assert key(got) == key(want)
    got = run(events.latest_state(stream(), ["user_id"], ["event_type"], ["ts", "event_id"]), "latest", "complete")
    want = events.latest_state(batch, ["user_id"], ["event_type"], ["ts", "event_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_drops_repeats_and_sink_is_idempotent(spark, data, tmp_path):
    table, schema = split_events(spark, data, tmp_path, 2)
    table.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: events.read_events(spark, str(tmp_path / "in"), schema, 1)
    assert run(events.once(stream(), ["event_id"], "3650 days"), "once", "append").count() == table.count()
    for attempt in range(2):  # the second run, with a checkpoint of its own, starts from the beginning
        events.keyed_sink(stream(), str(tmp_path / "out"), str(tmp_path / f"cp{attempt}"), ["event_id"]).awaitTermination()
        out = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
        assert out.count() == table.count() == out.select("event_id").distinct().count()
