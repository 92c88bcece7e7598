"""Queries over a store of embeddings and a history of runs. ``embeddings`` are
the store: labels choose the backend, numbers the scope and the track; ``orders``
and ``part`` stand for runs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import history, indexing, segments, store
from tessera.sources.tables import load

BACKENDS, SCOPES = ["alpha", "beta", "gamma"], ["full", "segment", "representative", "text"]


def _pick(values: list[str], i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _store(spark, d) -> DataFrame:
    e, n = load(spark, d, "embeddings"), F.col("vec_id")
    rows = e.select(n.cast("string").alias("key"), _pick(BACKENDS, F.col("label")).alias("backend"), _pick(SCOPES, n).alias("scope"), F.when(n % 4 != 3, F.floor(n / 8)).alias("track_id"), F.lit(0.0).alias("start_s"), F.lit(30.0).alias("end_s"))
    rows = rows.withColumns({"path": F.concat(F.lit("/m/"), "key"), "seq": F.lit(0)}).join(e.select(n.cast("string").alias("key"), F.col("embedding").alias("vector")), "key")
    return rows.withColumns({"dimension": F.size("vector"), "digest": store.digest()})


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("key", "backend", "scope", "track_id", "path")


def store_put(spark, d):
    """The store after half of its rows are put again from other paths: some have none, some an unknown backend."""
    held = _store(spark, d)
    n = F.col("key").cast("long")
    new = held.filter(n % 2 == 0).withColumns({"seq": F.lit(1), "path": F.when(n % 10 != 0, F.concat(F.lit("/new/"), "key")), "backend": F.when(n % 14 == 0, "delta").otherwise(F.col("backend"))}).drop("dimension", "digest")
    models = spark.createDataFrame([(b, 64, 0) for b in BACKENDS], "fingerprint string, dimension int, seq int")
    return _shown(store.put(held, new, models))


def store_refused(spark, d):
    held, n = _store(spark, d), F.col("key").cast("long")
    new = held.withColumns({"path": F.when(n % 10 != 0, F.col("path")), "vector": F.when(n % 6 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector"))})
    models = spark.createDataFrame([(b, 64, 0) for b in BACKENDS[:2]], "fingerprint string, dimension int, seq int")
    return store.guarded(new, models).groupBy("refused").agg(F.count("*").alias("rows"))


def store_delete(spark, d):
    """Without one backend's full rows, the keys of a list, and corrupt rows (their vectors or digests were changed)."""
    held, n = _store(spark, d), F.col("key").cast("long")
    broken = held.withColumns({"digest": F.when(n % 11 == 0, "x").otherwise(F.col("digest")), "vector": F.when(n % 13 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))})
    keys = held.filter(n % 9 == 0).select("key")
    return _shown(store.without_corrupt(store.without_keys(store.without_scope(broken, "alpha"), keys)))


def store_moved(spark, d):
    held = _store(spark, d)
    paths = held.filter(F.col("key").cast("long") % 5 == 0).select("key", F.concat(F.lit("/moved/"), "key").alias("new_path"))
    return _shown(store.moved(held, paths))


def store_counts(spark, d):
    return store.counts(_store(spark, d), "beta")


def query_log(spark, d):
    """Searches of the events, of which the valid ones are logged."""
    e = load(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "text").otherwise("audio").alias("query_type"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("query_text"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("query_track"), (F.col("event_id") % 7).cast("int").alias("top_k"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), "event_type").alias("filters"),
    )
    log = rows.limit(0).withColumn("filters", F.lit("").alias("filters"))
    return store.logged(log, rows).select("id", "query_type", "top_k", "filters")


def store_acceptance(spark, d):
    """Whether enough readable tracks have a full row."""
    catalog = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("track_id")).distinct()
    out = store.acceptance(catalog, _store(spark, d), "alpha", F.col("track_id") % 6 != 0)
    return out.withColumn("coverage", F.round("coverage", 6))


def store_retry(spark, d):
    """The readable tracks without a whole full row; rows of every fifth number are corrupt."""
    catalog = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("track_id")).distinct()
    held = _store(spark, d).withColumn("digest", F.when(F.col("key").cast("long") % 5 == 0, "x").otherwise(F.col("digest")))
    return store.to_retry(catalog, held, "alpha", F.col("track_id") % 6 != 0)


def store_rebuilt(spark, d):
    """Counts by backend and scope after one backend's full rows were made anew from every third."""
    held = _store(spark, d)
    new = held.filter("backend = 'beta' AND scope = 'full'").filter(F.col("key").cast("long") % 3 == 0).withColumn("seq", F.lit(1))
    return store.rebuilt(held, "beta", new).groupBy("backend", "scope").agg(F.count("*").alias("rows"), F.sum("seq").alias("new"))


def chosen_segments(spark, d):
    """Of each track the segment nearest to the centroid of its segments."""
    return store.chosen_segments(_store(spark, d).withColumn("track_id", F.col("track_id") % 5), "beta", "v1").select("track_id", "key", F.round("score", 6).alias("score"))


def _chosen(spark, d) -> DataFrame:
    """The representatives of every second track: the row with the greatest key."""
    own = _store(spark, d).filter("scope = 'representative' AND track_id % 2 = 0")
    return own.groupBy("backend", "track_id").agg(F.max(F.col("key").cast("long")).cast("string").alias("key")).withColumn("policy", F.lit("v1"))


def representative_replace(spark, d):
    return _shown(store.replaced_representatives(_store(spark, d), _chosen(spark, d)))


def segment_status(spark, d):
    catalog = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("track_id"))
    return store.segment_status(_store(spark, d), catalog, _chosen(spark, d), "beta", "v1")


def interval_search(spark, d):
    """The segments nearest to a query's vector, with their customers."""
    held = _store(spark, d)
    query = held.filter("key = '8'").select("vector").first()[0]
    hits = store.interval_search(held, "beta", query, 5.0, 20.0, track=1, target="segment", k=15)
    catalog = load(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("title"))
    return store.enriched(hits.select("rank", "track_id", F.round("similarity", 6).alias("similarity")), catalog)


def chunk_centroids(spark, d):
    """Weighted centroids by label; a row shows the first members."""
    e = load(spark, d, "embeddings").select("label", "embedding", (F.col("vec_id") % 5).alias("weight"))
    found = store.weighted_centroid(e, ["label"], "embedding")
    return found.select("label", *[F.round(F.get("embedding", i), 6).alias(f"x{i}") for i in range(4)])


def chunk_plan(spark, d):
    """The chunks of the documents' characters."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(store.chunk_starts(F.coalesce("n_chars", F.lit(0)).cast("int"), 128)).alias("chunk", "start"))


def segment_index_work(spark, d):
    """The segments of all parts (their prices are durations) that the store lacks."""
    media = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item"), (F.col("p_retailprice") / 10).alias("duration"))
    plan = segments.plan_segments(media, "duration", most=5)
    catalog = plan.select(F.concat_ws(":", "item", "segment").alias("item"), "start_s", "end_s")
    held = catalog.filter(F.length("item") % 3 == 0).select(F.lit("hash-16").alias("backend"), indexing.cache_key("hash-16").alias("key"))
    return indexing.work(catalog, held, "hash-16").select("item", "start_s", "end_s")


def track_identity(spark, d):
    """Files that are known by path, size and time keep their track; the others are hashed."""
    p = load(spark, d, "part")
    files = p.select(F.col("p_name").alias("path"), F.col("p_size").alias("size_bytes"), F.col("p_partkey").alias("modified"), F.concat_ws("|", "p_brand", "p_type").alias("content"))
    locations = p.filter("p_partkey % 3 <> 0").select(F.col("p_name").alias("path"), (F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).alias("size_bytes"), F.col("p_partkey").alias("modified"), F.concat(F.lit("known:"), "p_partkey").alias("track_id"))
    return history.identified(files, locations).select("path", "modified", "track_id", "hashed")


def tracks_seen(spark, d):
    """Tracks after the F runs were written into a history of the P runs."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderdate").alias("seen_at"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 1000).alias("size_bytes"), "o_orderstatus")
    none = spark.createDataFrame([], "track_id long, first_seen timestamp_ntz, last_seen timestamp_ntz, last_path string, size_bytes long")
    held = history.seen_tracks(none, o.filter("o_orderstatus = 'P'"))
    return history.seen_tracks(held, o.filter("o_orderstatus = 'F'"))


def run_upsert(spark, d):
    """Scores after every third order's run was written again with other scores."""
    lines = load(spark, d, "lineitem")
    held = lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("score"))
    new = lines.filter("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("l_linestatus").alias("label"), F.lit(1.0).alias("score")))).alias("styles"))
    return history.written_scores(held, new, "styles")


QUERIES = {f.__name__: f for f in (store_put, store_refused, store_delete, store_moved, store_counts, query_log, store_acceptance, store_retry, store_rebuilt, chosen_segments, representative_replace, segment_status, interval_search, chunk_centroids, chunk_plan, segment_index_work, track_identity, tracks_seen, run_upsert)}

_STORE = """st AS (
  SELECT vec_id AS n, vec_id::VARCHAR AS key, ['alpha', 'beta', 'gamma'][label % 3 + 1] AS backend, ['full', 'segment', 'representative', 'text'][vec_id % 4 + 1] AS scope,
         CASE WHEN vec_id % 4 <> 3 THEN vec_id // 8 END AS track_id, '/m/' || vec_id AS path, embedding FROM embeddings
)"""
_CHOSEN = "ch AS (SELECT backend, track_id, max(n)::VARCHAR AS k FROM st WHERE scope = 'representative' AND track_id % 2 = 0 GROUP BY ALL)"
SQL = {
    "store_put": f"WITH {_STORE} SELECT key, backend, scope, track_id, CASE WHEN n % 2 = 0 AND n % 14 <> 0 AND (scope = 'text' OR n % 10 <> 0) THEN CASE WHEN n % 10 <> 0 THEN '/new/' || key END ELSE path END AS path FROM st",
    "store_refused": f"WITH {_STORE} SELECT CASE WHEN backend = 'gamma' THEN 'unknown backend' WHEN n % 6 = 0 THEN 'other dimension' WHEN scope <> 'text' AND n % 10 = 0 THEN 'no path' END AS refused, count(*) AS rows FROM st GROUP BY 1",
    "store_delete": f"WITH {_STORE} SELECT key, backend, scope, track_id, path FROM st WHERE NOT (backend = 'alpha' AND scope = 'full') AND n % 9 <> 0 AND n % 11 <> 0 AND n % 13 <> 0",
    "store_moved": f"WITH {_STORE} SELECT key, backend, scope, track_id, CASE WHEN n % 5 = 0 AND scope <> 'text' THEN '/moved/' || key ELSE path END AS path FROM st",
    "store_counts": f"WITH {_STORE} SELECT coalesce(scope, 'total') AS scope, count(*) AS rows FROM st WHERE backend = 'beta' GROUP BY ROLLUP (scope)",
    "query_log": """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'audio' END AS query_type, (event_id % 7)::INT AS top_k, '{"kind":"' || event_type || '","user":"' || user_id || '"}' AS filters
        FROM events WHERE event_id % 7 > 0 AND CASE WHEN event_id % 2 = 0 THEN event_id % 4 <> 0 ELSE event_id % 3 <> 0 END""",
    "store_acceptance": f"""WITH {_STORE}, c AS (SELECT DISTINCT vec_id // 8 AS t, (vec_id // 8) % 6 <> 0 AS r FROM embeddings), h AS (SELECT DISTINCT track_id FROM st WHERE backend = 'alpha' AND scope = 'full')
        SELECT count(*) AS tracks, count(*) FILTER (r) AS readable, count(*) FILTER (r AND track_id IS NOT NULL) AS embedded, round(count(*) FILTER (r AND track_id IS NOT NULL)::DOUBLE / count(*) FILTER (r), 6) AS coverage,
        count(*) FILTER (r AND track_id IS NOT NULL)::DOUBLE / count(*) FILTER (r) >= 0.99 AS accepted FROM c LEFT JOIN h ON t = track_id""",
    "store_retry": f"WITH {_STORE} SELECT DISTINCT vec_id // 8 AS track_id FROM embeddings WHERE (vec_id // 8) % 6 <> 0 AND vec_id // 8 NOT IN (SELECT track_id FROM st WHERE backend = 'alpha' AND scope = 'full' AND n % 5 <> 0)",
    "store_rebuilt": f"WITH {_STORE} SELECT backend, scope, count(*) FILTER (NOT (backend = 'beta' AND scope = 'full') OR n % 3 = 0) AS rows, count(*) FILTER (backend = 'beta' AND scope = 'full' AND n % 3 = 0) AS new FROM st GROUP BY ALL HAVING count(*) FILTER (NOT (backend = 'beta' AND scope = 'full') OR n % 3 = 0) > 0",
    "chosen_segments": f"""WITH {_STORE}, e AS (SELECT track_id % 5 AS track_id, n, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM st WHERE backend = 'beta' AND scope = 'segment'),
        c AS (SELECT track_id, i, avg(x) AS m FROM e GROUP BY ALL), u AS (SELECT track_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY track_id)) AS m FROM c), s AS (SELECT track_id, n, sum(x * m) AS s FROM e JOIN u USING (track_id, i) GROUP BY ALL)
        SELECT track_id, arg_max(n, (s, -n))::VARCHAR AS key, round(max(s), 6) AS score FROM s GROUP BY track_id""",
    "representative_replace": f"WITH {_STORE}, {_CHOSEN} SELECT key, backend, scope, track_id, path FROM st LEFT JOIN ch USING (backend, track_id) WHERE scope <> 'representative' OR k IS NULL OR k = key",
    "segment_status": f"""WITH {_STORE}, {_CHOSEN} SELECT (SELECT count(DISTINCT vec_id // 8) FROM embeddings) AS tracks, (SELECT count(DISTINCT track_id) FROM ch WHERE backend = 'beta') AS represented,
        count(*) FILTER (backend = 'beta' AND scope = 'segment') AS segments, count(*) FILTER (backend = 'beta' AND scope = 'representative') AS representatives,
        count(*) FILTER (backend <> 'beta' AND scope = 'segment') AS stale_segments, count(*) FILTER (backend <> 'beta' AND scope = 'representative') AS stale_representatives FROM st""",
    "interval_search": f"""WITH {_STORE}, h AS (SELECT a.track_id, list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS s
        FROM st a, st b WHERE b.n = 8 AND a.backend = 'beta' AND a.scope = 'segment' AND a.track_id <> 1),
        r AS (SELECT *, row_number() OVER (ORDER BY s DESC, track_id)::INT AS rank FROM h)
        SELECT rank, track_id, round(s, 6) AS similarity, c_name AS title FROM r LEFT JOIN customer ON c_custkey = track_id WHERE rank <= 15""",
    "chunk_centroids": """WITH e AS (SELECT label, vec_id % 5 AS w, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, sum(x * w) / sum(w) AS m FROM e WHERE w > 0 GROUP BY ALL),
        n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c)
        SELECT label, """ + ", ".join(f"round(max(m) FILTER (i = {i}), 6) AS x{i}" for i in range(4)) + " FROM n GROUP BY label",
    "chunk_plan": """WITH n AS (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN n <= 128 THEN [0] WHEN n % 128 = 0 THEN range(0, n - 127, 128) ELSE list_append(range(0, n - 127, 128), n - 128) END) AS start FROM n)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk, start::INT AS start FROM s""",
    "segment_index_work": """WITH t AS (SELECT p_partkey::VARCHAR AS k, p_retailprice / 10 AS s FROM part), c AS (SELECT *, CASE WHEN s >= 1 THEN least(ceil(s / 30), floor((s - 1) / 30) + 1) ELSE 0 END::INT AS n FROM t),
        p AS (SELECT k, s, unnest(CASE WHEN n <= 5 THEN range(n) ELSE list_transform(range(5), lambda i: round_even(i * (n - 1)::DOUBLE / 4, 0)::BIGINT) END) AS i, unnest(range(least(n, 5))) AS g FROM c)
        SELECT k || ':' || g AS item, round(i * 30.0::DOUBLE, 6) AS start_s, round(least(i * 30.0::DOUBLE + 30, s), 6) AS end_s FROM p WHERE length(k || ':' || g) % 3 <> 0""",
    "track_identity": """WITH l AS (SELECT p_name, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS size, p_partkey AS k FROM part WHERE p_partkey % 3 <> 0)
        SELECT part.p_name AS path, p_partkey AS modified, CASE WHEN k IS NULL THEN 'sha256:' || sha256(p_brand || '|' || p_type) ELSE 'known:' || k END AS track_id, k IS NULL AS hashed
        FROM part LEFT JOIN l ON part.p_name = l.p_name AND p_size = size AND p_partkey = k""",
    "tracks_seen": """WITH o AS (SELECT o_custkey AS track_id, o_orderdate AS t, lpad(o_orderkey::VARCHAR, 12, '0') AS path, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END AS size, o_orderstatus AS s FROM orders),
        p AS (SELECT track_id, min(t) AS first_t, max(t) AS t, arg_max(path, (t, path)) AS path, arg_max(size, (t, path)) FILTER (size IS NOT NULL) AS size FROM o WHERE s = 'P' GROUP BY track_id),
        b AS (SELECT track_id, first_t, t, path, size FROM p UNION ALL SELECT track_id, t, t, path, size FROM o WHERE s = 'F')
        SELECT track_id, min(first_t) AS first_seen, max(t) AS last_seen, arg_max(path, (t, path)) AS last_path, arg_max(size, (t, path)) FILTER (size IS NOT NULL) AS size_bytes FROM b GROUP BY track_id""",
    "run_upsert": """SELECT l_orderkey AS run_id, l_linenumber AS rank, l_returnflag AS label, l_quantity AS score FROM lineitem WHERE l_orderkey % 3 <> 0
        UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus)::INT, l_linestatus, 1.0::DOUBLE FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem WHERE l_orderkey % 3 = 0)""",
}
