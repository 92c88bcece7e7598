"""Queries of session, version and benchmark reports, of an index of frames, and of what files hold: headers, chains,
parameters, lists and identities, each over a whole table whose columns stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels, verdicts
from tessera.operators import audit, history, indexing, sessions, structure
from tessera.plans.signal_queries import SIZE, frames_of
from tessera.sources import files
from tessera.sources.tables import load

N = F.col


def pick(values: list, index: Column) -> Column:
    """The value at ``index`` modulo their number; None is null."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def _outcomes(spark, d) -> DataFrame:
    k = N("p_partkey")
    return load(spark, d, "part").select(
        pick(["analyzed", "analyzed", "skipped", "analyzed", "error", "remaining", "analyzed"], k).alias("status"), pick([*labels.SEVERITIES, None], k).alias("mode_severity"), pick([None, *labels.SEVERITIES, None], N("p_size")).alias("history_severity"),
        (N("p_size") % 4 != 0).alias("history_comparable"), pick(["House", "Techno", None], k).alias("fast_genre"), pick(["House", "Techno", "House", None], N("p_size")).alias("auto_genre"), pick(["House", "Techno"], k).alias("accurate_genre"),
        (k % 6).alias("auto_windows"), (N("p_size") % 9).alias("accurate_windows"), labels.input_quality(N("p_size").cast("double")).alias("input_quality"), (k % 3).alias("duplicates"),
    )


def session_report(spark, d):
    """The counts of a validation session, in one row."""
    out = sessions.session_summary(_outcomes(spark, d))
    return out.withColumn("input_quality_counts", F.to_json("input_quality_counts"))


def version_report(spark, d):
    """The counts of a comparison of two versions, in one row."""
    k, s = N("p_partkey"), N("p_size")
    pairs = load(spark, d, "part").select(
        pick(labels.SEVERITIES, k).alias("severity"), (k % 5).alias("left_genre"), (s % 5).alias("right_genre"), (k % 2).alias("left_family"), (s % 2).alias("right_family"),
        labels.tempo_relation(60.0 + k % 80, 60.0 + s * 2).alias("tempo_relation"), (s / 100.0).alias("js_divergence"), (1 - s / 100.0).alias("cosine_similarity"),
    )
    out = sessions.version_summary(pairs)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_js_divergence", "mean_cosine_similarity")})


def benchmark_report(spark, d):
    """Means and latency percentiles over queries, whose seconds are the events' values."""
    k = N("event_id")
    queries = load(spark, d, "events").select(((k % 11) / 10.0).alias("precision_at_k"), ((k % 7) / 6.0).alias("recall_at_k"), (1.0 / (1 + k % 4)).alias("reciprocal_rank"), ((k % 5) / 4.0).alias("ndcg_at_k"), N("value").alias("embedding_seconds"), (N("value") / (1 + k % 3)).alias("ranking_seconds"))
    paired = load(spark, d, "events").filter("event_id % 2 = 0").select(((k % 9) / 8.0).alias("overlap"))
    out = sessions.benchmark_summary(queries, paired)
    return out.select("queries", *(F.round(c, 6).alias(c) for c in out.columns if c != "queries"))


def acoustic_index(spark, d):
    """The index of frames after files that it lacked were embedded: only those are new, and all vectors have length 1."""
    f, backend = frames_of(spark, d), indexing.AcousticBackend(32)
    catalog = f.select(N("path").alias("item")).distinct()
    held = catalog.filter("cast(item as long) % 3 = 0").select(indexing.cache_key(backend.name).alias("key"), F.lit(backend.name).alias("backend"), "item")
    new = indexing.updated_frames(catalog, f, held, backend)
    return new.select("item", F.size("vector").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 4).alias("length"))


def index_report(spark, d):
    """How many items an index has, lacks, or has of other backends."""
    e = load(spark, d, "embeddings")
    catalog = e.select(N("vec_id").cast("string").alias("item"))
    index = e.filter("vec_id % 4 <> 1").select(N("vec_id").cast("string").alias("item"), F.when(N("vec_id") % 5 < 3, "now").otherwise("before").alias("backend"))
    return indexing.run_report(catalog, index, "now")


def window_tag_means(spark, d):
    """The three labels of the greatest mean probability over each file's windows: a vector's first eight members are logits."""
    rows = load(spark, d, "embeddings").select(F.expr("cast(vec_id div 16 as string)").alias("item"), F.posexplode(F.slice("embedding", 1, 8)).alias("i", "x"))
    return indexing.window_tags(rows.select("item", F.concat(F.lit("tag"), "i").alias("label"), N("x").cast("double").alias("logit")), most=3)


def attack_pair_quantiles(spark, d):
    """Median and 95th percentile of the similarities of all pairs of a file's attacks, 32 vectors each."""
    rows = load(spark, d, "embeddings").select(F.expr("cast(vec_id div 32 as string)").alias("path"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.lit(1.0).alias("level"), N("label").cast("double").alias("peak_ms"))
    out = structure.attack_summary(rows)
    return out.select("path", "transient_count", *(F.round(c, 6).alias(c) for c in ("attack_similarity_median", "attack_similarity_p95", "attack_energy_cv", "attack_time_cv")))


def corrupt_rows(spark, d):
    """Stored vectors (the texts' first bytes) whose digest or length is not what was stored, by source."""
    rows = load(spark, d, "documents").select("doc_id", "source", F.substring(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 1, 64).alias("blob"))
    rows = rows.withColumn("digest", F.sha2(F.when(N("doc_id") % 5 == 0, F.lit(b"other")).otherwise(N("blob")), 256))
    bad = audit.corrupt(rows, "blob", "digest", 16)
    return rows.groupBy("source").agg(F.count("*").alias("rows")).join(bad.groupBy("source").agg(F.count("*").alias("corrupt")), "source", "left").select("source", "rows", F.coalesce("corrupt", F.lit(0)).alias("corrupt"))


def table_digest(spark, d):
    """A digest of a table's rows in any order."""
    return audit.table_fingerprint(load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def stored_comparisons(spark, d):
    """A log of comparisons after those that it lacked were added."""
    pairs = load(spark, d, "orders").select(N("o_custkey").cast("string").alias("track_id"), (N("o_orderkey") % 7).cast("string").alias("left_run"), (N("o_orderkey") % 5).cast("string").alias("right_run"), N("o_orderstatus").alias("kind"))
    held = pairs.filter("kind = 'F'").distinct().withColumn("comparison_id", F.sha2(F.concat_ws("|", "track_id", "left_run", "right_run", "kind"), 256))
    return history.stored_comparisons(held, pairs).groupBy("kind").agg(F.count("*").alias("rows"), F.count_distinct("comparison_id").alias("ids"))


def option_lists(spark, d):
    """Options given with commas, their members and those that any wish names."""
    given = F.concat(F.lit(" , "), "p_brand", F.lit(",, "), "p_type", F.lit(" ,"))
    own = labels.split_values(given)
    return load(spark, d, "part").select("p_partkey", F.array_join(own, "|").alias("members"), F.array_join(labels.clean_list(F.transform(own, lambda v: F.concat(F.lit("  "), v))), "|").alias("cleaned"), labels.overlaps(own, ["brand#1", "BRAND#2"]).alias("wanted"))


def name_tokens(spark, d):
    """Names made safe for files, paths' parents, numbers of texts, levels, tempo readings, confidences and rates of work."""
    k, s = N("p_partkey"), N("p_size")
    path = F.concat(F.lit("/music/"), "p_brand", F.lit("/"), "p_name", F.lit(".wav"))
    return load(spark, d, "part").select(
        "p_partkey", labels.safe_token("p_name").alias("token"), labels.parent_folder(path).alias("folder"), labels.compact(F.concat(F.lit("  "), "p_name", F.lit("\n\t "), "p_type"), 20).alias("short"),
        labels.optional_float(F.when(k % 3 == 0, "N/A").otherwise(s.cast("string"))).alias("number"), F.round(labels.decibels((s % 5) / 10.0), 6).alias("db"), labels.tempo_candidates(F.when(k % 4 > 0, s * 2.5)).alias("tempos"),
        labels.confidence_score(pick(["low", "Low-Medium", "MEDIUM", "medium-high", "high", "none"], k)).alias("confidence"), F.round(labels.throughput(k.cast("double"), (s % 4).cast("double")), 6).alias("rate"),
    )


def identities(spark, d):
    """Hashes of what identifies a result and a text, and a commit that a text marks."""
    p = load(spark, d, "part")
    note = F.concat(F.lit("Reviewed HEAD: "), F.when(N("p_partkey") % 3 > 0, F.upper(F.left(F.sha2("p_name", 256), F.lit(40)))).otherwise("none"), F.lit(" ok"))
    return p.select("p_partkey", labels.canonical_hash("p_size", "p_brand").alias("result_key"), labels.text_identity(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("text_key"), labels.marked_value(note, "head:").alias("commit"))


def comparable_verdicts(spark, d):
    """Whether pairs of runs can be compared, and why not."""
    q = lambda c: labels.input_quality(N(c).cast("double"))
    p = load(spark, d, "part").withColumn("other", N("p_partkey") % 50)
    yes, why = verdicts.comparable(q("p_size"), q("other"), F.when(N("p_size") % 4 > 0, N("p_brand")), F.when(N("p_partkey") % 5 > 0, N("p_brand")))
    return p.groupBy(yes.alias("comparable"), why.alias("reason")).agg(F.count("*").alias("pairs"))


def chains(spark, d):
    """Names put into a chain's bytes and read back."""
    made = load(spark, d, "part").select("p_partkey", files.chain_of(F.array("p_brand", "p_type", "p_name")).alias("chain"))
    return made.select("p_partkey", F.array_join(files.chain_names("chain"), "|").alias("names"), F.length(F.unbase64("chain")).alias("bytes"))


def patch_maps(spark, d):
    """The parameters of patches given as JSON of elements and parameters."""
    text = F.to_json(F.create_map(F.col("p_brand"), F.create_map(F.lit("size"), N("p_size").cast("string"), F.lit("name"), N("p_name"))))
    return load(spark, d, "part").select("p_partkey", F.explode(files.patch_map(text)).alias("p")).select("p_partkey", "p.*")


def wav_headers(spark, d):
    """Rates, channels, depths and lengths read from the bytes of headers."""
    little = lambda x, n: F.concat(*(F.substring(F.lpad(F.hex(x.cast("long")), 2 * n, "0"), i, 2) for i in range(2 * n - 1, 0, -2)))
    rate, channels, bits, size = pick([8000, 22050, 44100, 48000], N("p_partkey")), N("p_partkey") % 2 + 1, pick([8, 16, 24], N("p_size")), N("p_size") * 4800
    text = lambda s: F.lit(s.encode().hex())
    head = F.concat(text("RIFF"), little(size + 36, 4), text("WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(rate * channels * bits / 8, 4), little(channels * bits / 8, 2), little(bits, 2), text("data"), little(size, 4))
    rows = load(spark, d, "part").select("p_partkey", files.wav_header(F.unhex(F.when(N("p_partkey") % 11 == 0, text("RIFX")).otherwise(head))).alias("h"))
    return rows.select("p_partkey", "h.rate", "h.channels", "h.bits", F.round("h.seconds", 6).alias("seconds"), F.round("h.kbps", 6).alias("kbps"))


def float_vectors(spark, d):
    """Vectors sent as base64 of 32-bit floats."""
    words = [("0000803F", 1.0), ("0000C03F", 1.5), ("000020C1", -10.0), ("00000000", 0.0)]
    raw = F.concat(*(pick([w for w, _ in words], N("p_partkey") + i) for i in range(3)))
    x = files.float_array(F.base64(F.unhex(raw)))
    return load(spark, d, "part").select("p_partkey", F.size(x).alias("dimension"), *(F.get(x, i).alias(f"x{i}") for i in range(3)))


def content_tracks(spark, d):
    """The documents that share a content: the first path, and how many others there are."""
    rows = load(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("track_id"), F.lpad(N("doc_id").cast("string"), 10, "0").alias("path"))
    return files.tracks_of(rows).select("track_id", "path", F.size("others").alias("others"))


def defaulted_rows(spark, d):
    """Rows of an older schema with the columns that it lacks."""
    old = load(spark, d, "part").select("p_partkey", F.when(N("p_size") % 3 > 0, N("p_size")).alias("windows"))
    return files.with_defaults(old, {"windows": F.lit(1), "mode": F.lit("auto")}).groupBy("windows", "mode").agg(F.count("*").alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        session_report, version_report, benchmark_report, acoustic_index, index_report, window_tag_means, attack_pair_quantiles, corrupt_rows, table_digest, stored_comparisons, option_lists, name_tokens, identities,
        comparable_verdicts, chains, patch_maps, wav_headers, float_vectors, content_tracks, defaulted_rows,
    )
}

_SEVERITY = "CASE {0} WHEN 0 THEN 'STABLE' WHEN 1 THEN 'MINOR' WHEN 2 THEN 'SIGNIFICANT' WHEN 3 THEN 'CRITICAL' END"
_COUNTS = ", ".join(f"count(*) FILTER (a AND greatest(m, h) = {i}) AS severity_{s}, count(*) FILTER (a AND m = {i}) AS mode_{s}, count(*) FILTER (a AND h = {i}) AS history_{s}" for i, s in enumerate(("stable", "minor", "significant", "critical")))
_QUALITY = "CASE WHEN {0} < 10 THEN 'INSUFFICIENT_AUDIO' WHEN {0} < 30 THEN 'SHORT_INPUT' ELSE 'NORMAL' END"
_PCT = "CASE WHEN {1} > 0 THEN round(100.0::DOUBLE * {0} / {1}, 2) ELSE 0 END"
SQL = {
    "session_report": f"""WITH o AS (SELECT ['analyzed', 'analyzed', 'skipped', 'analyzed', 'error', 'remaining', 'analyzed'][p_partkey % 7 + 1] AS status, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 END AS m, CASE WHEN p_size % 6 BETWEEN 1 AND 4 THEN p_size % 6 - 1 END AS h,
          p_size % 4 <> 0 AS c, ['House', 'Techno', NULL][p_partkey % 3 + 1] AS f, ['House', 'Techno', 'House', NULL][p_size % 4 + 1] AS au, ['House', 'Techno'][p_partkey % 2 + 1] AS ac, p_partkey % 6 AS aw, p_size % 9 AS cw, {_QUALITY.format("p_size")} AS q, p_partkey % 3 AS d FROM part),
        x AS (SELECT *, status = 'analyzed' AS a FROM o), q AS (SELECT '{{' || string_agg('"' || q || '":' || n, ',' ORDER BY q) || '}}' AS counts FROM (SELECT q, count(*) AS n FROM x WHERE a GROUP BY q)),
        t AS (SELECT count(*) AS scanned_tracks, count(*) FILTER (status = 'analyzed') AS analyzed_tracks, count(*) FILTER (status = 'skipped') AS skipped_tracks, count(*) FILTER (status = 'error') AS error_tracks, count(*) FILTER (status = 'remaining') AS remaining_tracks,
          sum(d)::BIGINT AS duplicate_paths, {_COUNTS}, count(*) FILTER (a AND m IS NOT NULL) AS mode_comparison_tracks, count(*) FILTER (a AND h IS NOT NULL) AS history_comparison_tracks, count(*) FILTER (a AND NOT c) AS history_not_comparable_tracks,
          count(*) FILTER (a AND au IS NOT NULL) AS auto_vs_accurate_total, count(*) FILTER (a AND f IS NOT NULL) AS fast_vs_accurate_total, count(*) FILTER (a AND au = ac) AS same_auto, count(*) FILTER (a AND f = ac) AS same_fast,
          coalesce(sum(cw) FILTER (a AND cw > 0), 0)::BIGINT AS accurate_windows_total, coalesce(sum(aw) FILTER (a AND cw > 0), 0)::BIGINT AS auto_windows_total, count(*) FILTER (a AND cw > 0 AND aw < cw) AS auto_early_stop_tracks FROM x)
        SELECT * EXCLUDE (same_auto, same_fast, counts), {_PCT.format("same_auto", "auto_vs_accurate_total")} AS auto_vs_accurate_match_pct, {_PCT.format("same_fast", "fast_vs_accurate_total")} AS fast_vs_accurate_match_pct,
          greatest(accurate_windows_total - auto_windows_total, 0) AS saved_windows, {_PCT.format("greatest(accurate_windows_total - auto_windows_total, 0)", "accurate_windows_total")} AS saved_windows_pct, counts AS input_quality_counts FROM t, q""",
    "version_report": f"""WITH p AS (SELECT p_partkey % 4 AS s, p_partkey % 5 AS lg, p_size % 5 AS rg, p_partkey % 2 AS lf, p_size % 2 AS rf, 60.0::DOUBLE + p_partkey % 80 AS a, 60.0::DOUBLE + p_size * 2 AS b, p_size / 100.0::DOUBLE AS j FROM part),
        r AS (SELECT *, CASE WHEN abs(a - b) <= greatest(1, 0.025::DOUBLE * greatest(a, b)) THEN 'same' WHEN abs(a * 2 - b) <= greatest(1, 0.025::DOUBLE * greatest(a * 2, b)) OR abs(a - b * 2) <= greatest(1, 0.025::DOUBLE * greatest(a, b * 2)) THEN 'half-double' ELSE 'different' END AS t FROM p)
        SELECT count(*) AS compared_tracks, count(*) FILTER (s = 0) AS stable, count(*) FILTER (s = 1) AS minor, count(*) FILTER (s = 2) AS significant, count(*) FILTER (s = 3) AS critical, count(*) FILTER (t = 'same') AS tempo_same, count(*) FILTER (t = 'half-double') AS tempo_half_double,
        count(*) FILTER (t = 'different') AS tempo_different, {_PCT.format("count(*) FILTER (lg = rg)", "count(*)")} AS genre_match_pct, {_PCT.format("count(*) FILTER (lf = rf)", "count(*)")} AS family_match_pct, round(avg(j), 6) AS mean_js_divergence, round(avg(1 - j), 6) AS mean_cosine_similarity FROM r""",
    "benchmark_report": """SELECT count(*) AS queries, round(avg((event_id % 11) / 10.0::DOUBLE), 6) AS precision_at_k, round(avg((event_id % 7) / 6.0::DOUBLE), 6) AS recall_at_k, round(avg((event_id % 5) / 4.0::DOUBLE), 6) AS ndcg_at_k, round(avg(1.0::DOUBLE / (1 + event_id % 4)), 6) AS mrr,
        round(quantile_cont(value, 0.5), 6) AS embedding_p50, round(quantile_cont(value, 0.95), 6) AS embedding_p95, round(quantile_cont(value / (1 + event_id % 3), 0.5), 6) AS ranking_p50, round(quantile_cont(value / (1 + event_id % 3), 0.95), 6) AS ranking_p95,
        round(avg((event_id % 9) / 8.0::DOUBLE) FILTER (event_id % 2 = 0), 6) AS paired_overlap_mean FROM events""",
    "acoustic_index": "SELECT DISTINCT (vec_id // 16)::VARCHAR AS item, 78::INT AS dimension, 1.0::DOUBLE AS length FROM embeddings WHERE (vec_id // 16) % 3 <> 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0",
    "index_report": """SELECT count(*) AS catalog_rows, count(*) FILTER (vec_id % 4 <> 1 AND vec_id % 5 < 3) AS hits, count(*) FILTER (NOT (vec_id % 4 <> 1 AND vec_id % 5 < 3)) AS misses, count(*) FILTER (vec_id % 4 <> 1 AND vec_id % 5 >= 3) AS stale_rows FROM embeddings""",
    "window_tag_means": """WITH m AS (SELECT (vec_id // 16)::VARCHAR AS item, 'tag' || i AS label, avg(1 / (1 + exp(-(embedding[i + 1]::DOUBLE)))) AS s FROM embeddings, (SELECT unnest(range(8)) AS i) GROUP BY ALL)
        SELECT item, rank::INT AS rank, label, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, label DESC) AS rank FROM m) WHERE rank <= 3""",
    "attack_pair_quantiles": """WITH e AS (SELECT vec_id // 32 AS p, vec_id, label::DOUBLE AS t, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        s AS (SELECT a.p, list_inner_product(a.v, b.v) AS s FROM e a JOIN e b ON a.p = b.p AND a.vec_id < b.vec_id), q AS (SELECT p, quantile_cont(s, 0.5) AS m, quantile_cont(s, 0.95) AS h FROM s GROUP BY p),
        c AS (SELECT p, count(*) AS n, CASE WHEN count(*) < 2 THEN NULL WHEN abs(avg(t)) > 1e-12 THEN stddev_pop(t) / abs(avg(t)) WHEN max(abs(t)) <= 1e-8 THEN 0 END AS cv FROM e GROUP BY p)
        SELECT p::VARCHAR AS path, n AS transient_count, round(m, 6) AS attack_similarity_median, round(h, 6) AS attack_similarity_p95, CASE WHEN n >= 2 THEN 0.0::DOUBLE END AS attack_energy_cv, round(cv, 6) AS attack_time_cv FROM c LEFT JOIN q USING (p)""",
    "corrupt_rows": "SELECT source, count(*) AS rows, count(*) FILTER (doc_id % 5 = 0 OR strlen(coalesce(text, '')) < 64) AS corrupt FROM documents GROUP BY source",
    "table_digest": """WITH h AS (SELECT sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation), p AS (SELECT i, sum(('0x' || substr(h, 1 + 8 * i, 8))::UBIGINT)::VARCHAR AS s FROM h, (SELECT unnest(range(4)) AS i) GROUP BY i)
        SELECT (SELECT count(*) FROM nation) AS rows, sha256((SELECT count(*) FROM nation) || ':' || string_agg(s, ':' ORDER BY i)) AS digest FROM p""",
    "stored_comparisons": "SELECT o_orderstatus AS kind, count(DISTINCT (o_custkey, o_orderkey % 7, o_orderkey % 5)) AS rows, count(DISTINCT (o_custkey, o_orderkey % 7, o_orderkey % 5)) AS ids FROM orders GROUP BY o_orderstatus",
    "option_lists": "SELECT p_partkey, p_brand || '|' || p_type AS members, p_brand || '|' || p_type AS cleaned, lower(p_brand) IN ('brand#1', 'brand#2') OR lower(p_type) IN ('brand#1', 'brand#2') AS wanted FROM part",
    "name_tokens": """SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}._-]', '_', 'g') AS token, '/music/' || p_brand AS folder, left(trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g')), 20) AS short, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS number,
        CASE WHEN p_size % 5 = 0 THEN -300 ELSE round(20 * log10((p_size % 5) / 10.0::DOUBLE), 6) END AS db,
        CASE WHEN p_partkey % 4 > 0 AND p_size > 0 THEN printf('%.2f BPM  |  half %.2f  |  2/3 %.2f  |  double %.2f', p_size * 2.5::DOUBLE, p_size * 2.5::DOUBLE / 2, p_size * 2.5::DOUBLE * 2 / 3, p_size * 2.5::DOUBLE * 2) ELSE 'n/a' END AS tempos,
        [0.2, 0.4, 0.6, 0.8, 1.0, NULL][p_partkey % 6 + 1]::DOUBLE AS confidence, round(CASE WHEN p_size % 4 > 0 THEN p_partkey::DOUBLE / (p_size % 4) END, 6) AS rate FROM part""",
    "identities": """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS result_key, sha256(trim(p_name)) AS text_key, CASE WHEN p_partkey % 3 > 0 THEN left(sha256(p_name), 40) END AS commit FROM part""",
    "comparable_verdicts": """WITH p AS (SELECT p_size < 10 OR p_partkey % 50 < 10 AS short, p_size % 4 = 0 OR p_partkey % 5 = 0 AS missing FROM part)
        SELECT NOT short AND NOT missing AS comparable, CASE WHEN short THEN 'too little audio for a verdict on one side' WHEN missing THEN 'no verdict on one side' ELSE '' END AS reason, count(*) AS pairs FROM p GROUP BY 1, 2""",
    "chains": "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS names, (15 + strlen(p_brand) + strlen(p_type) + strlen(p_name))::INT AS bytes FROM part",
    "patch_maps": "SELECT p_partkey, p_brand AS element, param, CASE param WHEN 'size' THEN p_size::VARCHAR ELSE p_name END AS value FROM part, (VALUES ('size'), ('name')) v(param)",
    "wav_headers": """WITH p AS (SELECT p_partkey, [8000, 22050, 44100, 48000][p_partkey % 4 + 1] AS rate, p_partkey % 2 + 1 AS channels, [8, 16, 24][p_size % 3 + 1] AS bits, p_size * 4800 AS size, p_partkey % 11 <> 0 AS good FROM part)
        SELECT p_partkey, CASE WHEN good THEN rate END::BIGINT AS rate, CASE WHEN good THEN channels END::INT AS channels, CASE WHEN good THEN bits END::INT AS bits, round(CASE WHEN good THEN size / (rate * channels * bits / 8.0::DOUBLE) END, 6) AS seconds, round(CASE WHEN good THEN rate * channels * bits / 1000.0::DOUBLE END, 6) AS kbps FROM p""",
    "float_vectors": "SELECT p_partkey, 3::INT AS dimension, [1.0, 1.5, -10.0, 0.0][p_partkey % 4 + 1]::DOUBLE AS x0, [1.0, 1.5, -10.0, 0.0][(p_partkey + 1) % 4 + 1]::DOUBLE AS x1, [1.0, 1.5, -10.0, 0.0][(p_partkey + 2) % 4 + 1]::DOUBLE AS x2 FROM part",
    "content_tracks": "SELECT sha256(coalesce(text, '')) AS track_id, min(lpad(doc_id::VARCHAR, 10, '0')) AS path, (count(DISTINCT doc_id) - 1)::INT AS others FROM documents GROUP BY 1",
    "defaulted_rows": "SELECT CASE WHEN p_size % 3 > 0 THEN p_size ELSE 1 END AS windows, 'auto' AS mode, count(*) AS rows FROM part GROUP BY 1",
}
