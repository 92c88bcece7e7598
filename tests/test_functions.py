import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, verdicts
from tessera.operators import audit, distributions, graph, latest, search, segments


def rows(styles, families):
    return [([(f"{k}", v) for k, v in styles], families)]


@pytest.mark.parametrize(
    ("styles", "families", "want"),
    [
        ([("Rock---Pop Rock", 0.216), ("Pop---Ballad", 0.120), ("Pop---Europop", 0.099)], [("Pop", 0.363), ("Rock", 0.346)], ("Pop Rock", "hybrid", "low-medium", "Pop Ballad")),
        ([("Rock---Heavy Metal", 0.266), ("Rock---Hard Rock", 0.120), ("Pop---Europop", 0.029)], [("Rock", 0.814), ("Pop", 0.060)], ("Heavy Metal", "primary", "high", "Hard Rock")),
        ([("Rock---Alternative Rock", 0.1724), ("Rock---Pop Punk", 0.1480), ("Electronic---Drum n Bass", 0.0489)], [("Rock", 0.7173), ("Electronic", 0.1475)], ("Alternative Rock", "primary", "medium", "Pop Punk")),
        ([("Pop---Schlager", 0.1263), ("Rock---Power Metal", 0.1029), ("Rock---Heavy Metal", 0.0978)], [("Rock", 0.5027), ("Pop", 0.3781)], ("Schlager", "hybrid", "low-medium", "Power Metal")),
        ([("Electronic---Dance-pop", 0.30), ("Pop---Indie Pop", 0.18)], [("Electronic", 0.50), ("Pop", 0.41)], ("Dance-pop", "hybrid", "low-medium", "Indie Pop")),
        ([], [], (None, "unknown", "low", None)),
        ([("Pop---Vocal", 0.3)], [("Pop", 0.9)], ("Vocal Pop", "primary", "high", None)),
    ],
)
def test_resolver(spark, styles, families, want):
    schema = "styles array<struct<label: string, score: double>>, families array<struct<label: string, score: double>>"
    r = verdicts.resolve(spark.createDataFrame([(styles, families)], schema)).first()
    assert (r.resolved, r.classification, r.confidence, r.secondary_style) == want


def test_tempo_relations(spark):
    df = spark.createDataFrame([(81.5, 163.0), (120.0, 121.0), (90.0, 130.0), (None, 1.0), (0.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(labels.tempo_relation("a", "b")).collect()] == ["same" if x == "=" else x for x in ("half-double", "=", "different", "unknown", "unknown")]


def test_windows_count_absent_labels(spark):
    r = [(1, 0, 0, "House", 0.8), (1, 0, 1, "Rock", 0.2), (1, 0, 2, "House", 0.1), (1, 1, 0, "House", 0.6), (1, 1, 1, "Rock", 0.4), (2, 0, 0, "A", -1.0)]
    got = distributions.reduce_windows(spark.createDataFrame(r, "u int, w int, pos int, label string, score double"), ["u"], "w").collect()
    assert {(x.u, x.label): round(x.score, 9) for x in got} == {(1, "House"): 0.7, (1, "Rock"): 0.3, (2, "A"): 0.0}


def test_drift_of_equal_disjoint_and_empty(spark):
    schema = "u int, label string, share double"
    left = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (3, "a", 0.0), (4, "a", 1.0)], schema)
    right = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "c", 1.0), (3, "a", 0.0), (4, "a", 0.0)], schema)
    got = {r.u: (round(r.cosine, 9), round(r.js, 9)) for r in distributions.drift(left, right, ["u"]).collect()}
    assert got[1] == (1.0, 0.0) and got[2] == (0.0, 1.0) and got[3] == (1.0, 0.0) and got[4][0] == 0.0


def test_segments(spark):
    media = spark.createDataFrame([("a", 65.0), ("b", 0.5), ("c", 300.0), ("d", None), ("e", 60.4)], "id string, s double")
    plan = {}
    for r in segments.plan_segments(media, "s").orderBy("id", "segment").collect():
        plan.setdefault(r.id, []).append((r.start_s, r.end_s, r.is_short))
    assert plan["a"] == [(0, 30, False), (30, 60, False), (60, 65, True)] and "b" not in plan and "d" not in plan
    assert len(plan["c"]) == 10 and plan["e"] == [(0, 30, False), (30, 60, False)]
    three = segments.plan_segments(media.filter("id = 'c'"), "s", most=3).orderBy("segment").collect()
    assert [r.start_s for r in three][0] == 0 and three[-1].start_s == 270 and len(three) == 3


def test_metrics_of_a_known_ranking(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 30, 2), (1, 20, 3)], "query_id long, vec_id long, rank int")
    grades = spark.createDataFrame([(1, 10, 3), (1, 20, 2), (1, 30, 0), (2, 10, 0)], "query_id long, vec_id long, grade int")
    got = {r.query_id: r for r in search.ranking_metrics(ranked, grades, k=3).collect()}
    assert math.isclose(got[1].precision_at_k, 2 / 3) and got[1].recall_at_k == 1 and got[1].reciprocal_rank == 1
    assert math.isclose(got[1].ndcg_at_k, (7 + 3 / 2) / (7 + 3 / math.log2(3)))
    assert (got[2].recall_at_k, got[2].ndcg_at_k, got[2].reciprocal_rank) == (0, 0, 0)
    sets = spark.createDataFrame([(["a", "c", "b"], ["a", "b", "d"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(search.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0]


def test_search_does_not_depend_on_the_order_of_rows(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    once = search.top_k_batch(e, q, k=5).orderBy("query_id", "rank").collect()
    assert once == search.top_k_batch(e.repartition(7, "label").orderBy(F.rand(1)), q.orderBy(F.rand(2)), k=5).orderBy("query_id", "rank").collect()
    one = search.top_k(e, q.filter("query_id = 20").first().embedding, k=5, exclude=20).orderBy("rank").collect()
    assert [r.vec_id for r in one] == [r.vec_id for r in once if r.query_id == 20]


def test_scope_refuses_duplicates(spark):
    runs = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "track string, t int, seq int")
    with pytest.raises(ValueError, match="several runs"):
        latest.scoped(runs, F.lit(True), "track", ["t", "seq"])
    kept = latest.scoped(runs, F.lit(True), "track", ["t", "seq"], "latest").collect()
    assert {(r.track, r.seq) for r in kept} == {("a", 2), ("b", 3)}
    changed = latest.upsert(runs, spark.createDataFrame([("b", 9, 9)], "track string, t int, seq int"), ["track"], ["t", "seq"]).collect()
    assert {(r.track, r.seq) for r in changed} == {("a", 2), ("b", 9)}


def test_severity_ladder_in_order(spark):
    f = lambda **x: spark.range(1).select(*verdicts.severity(**({"broad_match": F.lit(True), "both_high": F.lit(False), "js": F.lit(0.0), "class_match": F.lit(True), "tempo": F.lit("same"), "resolved_match": F.lit(True), "key_match": F.lit(None).cast("boolean"), "overlap": F.lit(1.0)} | x))).first()[0]
    assert f() == "STABLE" and f(key_match=F.lit(False)) == "MINOR" and f(resolved_match=F.lit(False)) == "MINOR"
    assert f(broad_match=F.lit(False), both_high=F.lit(True)) == "CRITICAL" and f(js=F.lit(0.45)) == "CRITICAL" and f(tempo=F.lit("different")) == "SIGNIFICANT"


def test_cycles_and_fingerprints(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    assert {r.src for r in graph.cycles(edges).collect()} == {1, 2, 3, 5}
    again = edges.repartition(3).orderBy(F.rand(3))
    assert audit.table_fingerprint(edges).first() == audit.table_fingerprint(again).first()
    assert audit.table_fingerprint(edges).first() != audit.table_fingerprint(edges.union(edges.limit(1))).first()


def test_differences_tell_null_from_absent(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (4, None)], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (5, None)], "k int, v string")
    assert {(r.k, r.change) for r in audit.differences(a, b, ["k"], "v").collect()} == {(2, "changed"), (3, "removed"), (4, "removed"), (5, "added")}
