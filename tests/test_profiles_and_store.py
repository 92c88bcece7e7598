import base64
import io
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, profiles
from tessera.operators import graph, history, store
from tessera.sources import files, reports
from tessera.sources.tables import spread

SCORES = "array<struct<label string, score double>>"
ROW = f"id string, styles {SCORES}, families {SCORES}, resolved string, confidence string, primary_family string, secondary_family string, secondary_style string, tags {SCORES}, bpm double, key string, mode string"
STYLES = [("Rock---Pop Rock", 0.1985), ("Pop---Ballad", 0.1294), ("Pop---Europop", 0.1076)]
FAMILIES = [("Pop", 0.4020), ("Rock", 0.3114)]
TAGS = [("Rock music", 0.80), ("Male singing", 0.72), ("Electric guitar", 0.61), ("Drum kit", 0.59), ("Exciting music", 0.44), ("Electronic music", 0.10)]


@pytest.fixture(scope="module")
def assembled(spark):
    electronic = [("Electronic", 0.4685), ("Pop", 0.2708), ("Rock", 0.1427)]
    synth = [("Pop---Indie Pop", 0.1278), ("Electronic---Synth-pop", 0.1272), ("Rock---Pop Rock", 0.0916)]
    rows = [
        ("fused", STYLES, FAMILIES, "Pop Ballad", "low-medium", "Pop", "Rock", "Pop Rock", TAGS, 81.52, "C", "minor"),
        ("sure", STYLES, FAMILIES, "Pop Ballad", "high", "Pop", "Rock", "Pop Rock", TAGS, 81.52, "C", "minor"),
        ("weak", STYLES, [("Pop", 0.40), ("Rock", 0.35), ("Electronic", 0.25)], "Pop Ballad", "medium", "Pop", "Rock", None, [("Rock music", 0.03)], None, None, None),
        ("reconciled", synth, electronic, "Indie Pop", "low-medium", "Electronic", "Pop", "Synth-pop", [], 100.0, "", ""),
        ("alone", [("Pop---Indie Pop", 0.20)], [("Electronic", 0.60), ("Pop", 0.30)], "Indie Pop", "low-medium", "Electronic", "Rock", "Pop Rock", [], 0.0, None, None),
        ("none", [], [], None, "low", None, None, None, [], None, None, None),
    ]
    return {r.id: r for r in profiles.assemble(spark.createDataFrame(rows, ROW)).collect()}


def test_profiles(assembled):
    r = assembled["fused"]
    assert (r.broad_family, r.primary_style, r.secondary, r.vocal, r.agreement) == ("Rock", "Pop Rock", "Pop Ballad", "Male singing", "mixed")
    assert r.instruments == ["Electric guitar", "Drum kit"] and r.moods == ["Exciting music"] and r.adjacent == ["Ballad", "Europop"]
    assert r.style_prompt == "Pop Rock, Pop Ballad influence, Exciting music, Male singing, Electric guitar, Drum kit, 82 BPM, C minor"
    assert abs(sum(x.score for x in r.evidence) - 1) < 1e-5 and r.profile_confidence == "low-medium"
    r = assembled["sure"]
    assert (r.broad_family, r.primary_style, r.profile_confidence) == ("Pop", "Pop Ballad", "medium")
    r = assembled["weak"]
    assert r.evidence[0].label == "Pop" and r.agreement == "mixed" and r.broad_family == "Pop"
    r = assembled["reconciled"]
    assert (r.broad_family, r.primary_style, r.secondary, r.distributor_genre, r.distributor_subgenre) == ("Electronic", "Synth-pop", "Indie Pop", "Electronic", "Synth-pop")
    r = assembled["alone"]
    assert (r.broad_family, r.primary_style, r.distributor_genre) == ("Pop", "Indie Pop", "Pop")
    r = assembled["none"]
    assert r.broad_family is None and r.style_prompt is None and r.evidence == [] and r.agreement == "maest_only"


def test_aliases_and_labels(spark):
    one = spark.range(1)
    alias = lambda label, style: one.select(F.coalesce(profiles.is_alias(F.lit(label), F.lit(style)), F.lit(False))).first()[0]
    assert alias("Pop---Ballad", " pop ballad") and alias("Pop---Vocal", "Vocal Pop") and alias("X", "x") and not alias("Pop---Ballad", "Rock Ballad")
    tags = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(0.5).alias("score")) for x in ("A", "a ", "Musical Instrument", "b", "C")])
    assert one.select(profiles.unique_labels(tags, 2, ["musical instrument"])).first()[0] == ["A", "b"]
    assert one.select(profiles.distributor(F.lit("Hip Hop")), profiles.distributor(F.lit("Noise"))).first()[:] == ("Hip-Hop/Rap", "Noise")
    assert one.select(labels.marked_value(F.lit("please @review head: " + "AB" * 20), "head:")).first()[0] == "ab" * 20
    assert one.select(labels.memory_percent(F.lit(5.0), F.lit(0.0)), labels.memory_free(F.lit(5.0), F.lit(3.0))).first()[:] == (None, 0.0)


EMBEDDING = "key string, backend string, scope string, track_id long, path string, vector array<float>, seq int"


def test_store_rows_are_checked(spark):
    models = store.register(spark.createDataFrame([("m", 2, 0)], "fingerprint string, dimension int, seq int"), spark.createDataFrame([("m", 2, 1), ("n", 3, 1)], "fingerprint string, dimension int, seq int"))
    assert sorted((r.fingerprint, r.seq) for r in models.collect()) == [("m", 1), ("n", 1)]
    new = spark.createDataFrame([("a", "m", "full", 1, "/a", [0.6, 0.8], 1), ("b", "m", "text", None, None, [1.0, 0.0], 1), ("c", "m", "full", 1, "", [1.0, 0.0], 1), ("d", "m", "full", 1, "/d", [1.0], 1), ("e", "x", "full", 1, "/e", [1.0], 1), ("f", "m", "full", 2, "/f", [3.0, 4.0], 1)], EMBEDDING)
    empty = new.limit(0).withColumns({"dimension": F.lit(0), "digest": F.lit("")})
    held = store.put(empty, new, models)
    assert {r.key for r in held.collect()} == {"a", "b", "f"}
    broken = held.withColumn("digest", F.when(F.col("key") == "b", "x").otherwise(F.col("digest")))
    state = lambda key, backend="m", scope="full": [r.state for r in store.get(broken, key, backend, scope).collect()]
    assert state("a") == ["ok"] and state("b", scope="text") == ["corrupt"] and state("a", "n") == ["mismatch"] and state("f") == ["corrupt"] and state("q") == []
    assert {r.key for r in store.without_corrupt(broken).collect()} == {"a"}
    again = new.filter("key = 'a'").withColumns({"path": F.lit("/z"), "seq": F.lit(2)})
    assert [r.path for r in store.put(held, again, models).filter("key = 'a'").collect()] == ["/z"]
    ids = [spark.range(1).select(store.identity_key(F.lit("m"), F.lit("full"), F.lit(1), F.lit(0.0), F.lit(e))).first()[0] for e in (1.0, 1.0004, 1.001)]
    assert ids[0] == ids[1] != ids[2]


def test_intervals_and_chunks(spark):
    for start, end in ((-1, 5), (5, 5), (1, 1.5)):
        with pytest.raises(ValueError):
            store.interval_search(None, "m", [1.0], start, end)
    starts = spark.createDataFrame([(0,), (5,), (8,), (9,)], "n int").select("n", store.chunk_starts(F.col("n"), 4).alias("s")).collect()
    assert [r.s for r in starts] == [[0], [0, 1], [0, 4], [0, 4, 5]]


def test_history_of_runs(spark):
    runs = spark.createDataFrame([("r1", "t", 1), ("r2", "t", 1)], "run_id string, track_id string, seq int")
    new = spark.createDataFrame([("r2", "u", 2, "x"), ("r3", "t", 2, "y")], "run_id string, track_id string, seq int, extra string")
    got = sorted((r.run_id, r.track_id, r.extra) for r in history.written_runs(runs, new).collect())
    assert got == [("r1", "t", None), ("r2", "u", "x"), ("r3", "t", "y")]
    pairs = spark.createDataFrame([("t", "r1", "r2", "build"), ("t", "r1", "r2", "build"), ("t", "r1", "r3", "build")], "track_id string, left_run string, right_run string, kind string")
    log = history.stored_comparisons(pairs.limit(0).withColumn("comparison_id", F.lit("")), pairs)
    assert log.count() == 2 and history.stored_comparisons(log, pairs).count() == 2
    locations = spark.createDataFrame([("/a", "t", 1, 1), ("/b", "t", 1, 1)], "path string, track_id string, size_bytes int, seen_at int")
    assert sorted((r.path, r.seen_at) for r in history.seen_locations(locations, locations.filter("path = '/a'").withColumn("seen_at", F.lit(2))).collect()) == [("/a", 2), ("/b", 1)]


def test_paths_of_any_length(spark):
    edges = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    far = graph.reach(edges).filter("src = 0").agg(F.count("*"), F.max("hops")).first()
    assert tuple(far) == (70, 70)


def test_only_small_tables_are_spread(spark):
    one, cores = spark.range(1000).coalesce(1), spark.sparkContext.defaultParallelism
    assert spread(one, most=1 << 40).rdd.getNumPartitions() == cores and spread(one, most=1) is one
    assert spread(dealt := one.repartition(cores), most=1 << 40) is dealt


def test_chains_headers_and_patches(spark):
    chain = base64.b64encode(b"".join(b"\0" + struct.pack("<I", len(n.encode())) + n.encode() for n in ("EQ", "Máx", "a" * 300))).decode()
    rows = spark.createDataFrame([(chain,), (base64.b64encode(b"\1ab").decode(),), (base64.b64encode(b"\0\xff\0\0\0ab").decode(),), ("",), (None,)], "c string")
    assert [r.n for r in rows.select(files.chain_names("c").alias("n")).collect()] == [["EQ", "Máx", "a" * 300], [None], [None], [], None]
    assert rows.limit(1).select(files.chain_of(files.chain_names("c"))).first()[0] == chain
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(3), w.setframerate(48000), w.writeframes(b"\0" * 6 * 24000)
    head = spark.createDataFrame([(out.getvalue(),), (b"nope",)], "content binary").select(files.wav_header("content").alias("h")).collect()
    assert head[0].h.asDict() == {"rate": 48000, "channels": 2, "bits": 24, "seconds": 0.5, "kbps": 2304.0} and head[1].h is None
    patch = spark.range(1).select(files.patch_map(F.lit('{"E": {"a": 1, "b": "x"}}'))).first()[0]
    assert [tuple(p) for p in patch] == [("E", "a", "1"), ("E", "b", "x")]


def test_contracts(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"type": "string", "minLength": 2, "enum": ["xx", "y"]}}}
    texts = ['{"a":5,"b":"xx"}', '{"a":1,"b":"y"}', '{"b":3,"c":1}', "[1]", "bad", '{"a":1.5}', None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "j string").select(files.violations(F.col("j"), schema).alias("v")).collect()]
    assert got[0] == [] and got[1] == ["$.a: is below 3", "$.b: is shorter than 2"] and got[3] == got[4] == got[6] == ["$: is no object"]
    assert got[2] == ["$: lacks a", "$: has further properties", "$.b: is no string", "$.b: is none of its values"] and got[5] == ["$.a: is no integer", "$.a: is below 3"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("/m/a b?.wav", "r1" * 8, [("Pop---X", 0.5), ("Rock---Y", 0.25)], ["s", "t"])], f"path string, run_id string, styles {SCORES}, tags array<string>")
    reports.write_report(rows.agg(F.count("*").alias("runs")), rows.drop("styles"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary.json")).first().runs == 1
    assert spark.read.option("header", "true").csv(str(tmp_path / "r/rows.csv")).first().tags == "s; t"
    reports.write_runs(rows, str(tmp_path / "runs"))
    assert [p.name for p in (tmp_path / "runs").iterdir() if p.is_dir()] == ["_file=a_b_.wav.r1r1r1r1"]
    wide = reports.wide_summary(rows, ["styles"], ["run_id"], top=2).first()
    assert (wide.styles_1, wide.styles_2_score, wide.styles_all) == ("Pop---X", 0.25, "Pop---X=0.5000; Rock---Y=0.2500")
    lines = [r.line for r in reports.marked(rows.select(F.lit('a "b", c').alias("x"), "tags")).orderBy("at").collect()]
    assert lines == ["﻿x,tags", '"a ""b"", c",s; t']
    both = reports.same_columns([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")])
    assert both.columns == ["a", "b"] and sorted(map(str, both.collect())) == ["Row(a=1, b=None)", "Row(a=3, b=2)"]
    assert reports.markdown(both.orderBy("a")) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 3 | 2 |\n"
    with pytest.raises(ValueError):
        reports.markdown(both, most=1)
    assert spark.range(1).select(reports.log_line("load", ms=F.lit(5))).first()[0] == '{"event":"load","ms":5}'


def test_named_files_and_defaults(spark, tmp_path):
    for name in ("a.genre.json", "d/b.genre2.json", "c.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"path": "p", "audio_features": {"bpm": 1.0}}')
    found = files.named_results(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.collect()) == ["a.genre.json", "b.genre2.json"]
    full = files.with_defaults(found.select("path", "confidence"), {"confidence": F.lit("low"), "schema": F.lit(1)}).first()
    assert (full.path, full.confidence, full.schema) == ("p", "low", 1)
    ids = spark.createDataFrame([("/b", "t"), ("/a", "t"), ("/c", "u")], "path string, track_id string")
    assert {r.track_id: (r.path, r.others) for r in files.tracks_of(ids).collect()} == {"t": ("/a", ["/b"]), "u": ("/c", [])}
    assert [r.path for r in files.selected(ids, ["path"], ids.filter("track_id = 't'"), most=1).collect()] == ["/a"]
    twice = spark.createDataFrame([("E", "p", "1"), ("E", "p", "2")], "element string, param string, value string")
    with pytest.raises(ValueError, match="'E', 'p'"):
        files.unique_parameters(twice)
    assert files.unique_parameters(twice.limit(1)).count() == 1
