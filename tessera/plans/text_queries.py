"""Queries of text and number functions, contracts, embeddings by a backend and
streams, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import indexing, search
from tessera.sources import files, reports
from tessera.sources.tables import load
from tessera.streaming import events, state

CONTRACT = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 30, "maximum": 70}}}


def loop_tempos(spark, d):
    """Tempos of short loops: sizes are tempos, numbers are seconds."""
    p = load(spark, d, "part")
    bpm, seconds = 60 + F.col("p_size") * 1.7, 4 + (F.col("p_partkey") % 60) * 0.5
    return p.select("p_partkey", F.round(labels.loop_tempo(bpm, seconds), 6).alias("bpm"))


def window_starts(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(labels.even_starts(F.coalesce("n_chars", F.lit(0)), 500, 5)).alias("place", "start"))


def version_numbers(spark, d):
    p = load(spark, d, "part")
    version = F.concat("p_size", F.lit("."), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("rc"), F.col("p_partkey") % 3)).otherwise(""), F.lit("+cu"), "p_partkey")
    v = labels.version_triple(version)
    return p.select("p_partkey", F.get(v, 0).alias("major"), F.get(v, 1).alias("minor"), F.get(v, 2).alias("patch"))


def number_formats(spark, d):
    """Prices written as an old text was."""
    p = load(spark, d, "part")
    old = F.element_at(F.array(F.lit("1,5"), F.lit("1.5"), F.lit("7")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", labels.like_existing(old, F.floor("p_retailprice") + F.when(F.col("p_partkey") % 2 == 0, 0.25).otherwise(0.0)).alias("text"))


def source_labels(spark, d):
    n = F.col("p_partkey")
    rate = F.element_at(F.array(F.lit(44100), F.lit(48000), F.lit(22050)), (n % 3 + 1).cast("int"))
    bits = F.when(n % 4 != 0, F.lit(8) + 8 * (n % 3)).cast("int")
    kbps = F.when(n % 5 != 0, rate * (n % 4 + 1) * F.coalesce(bits, F.lit(16)) / 1000.0)
    return load(spark, d, "part").select("p_partkey", labels.source_label(F.lit("WAV"), "p_type", rate, bits, (n % 4 + 1).cast("int"), kbps).alias("label"), labels.path_identity("p_name").alias("path_id"))


def memory_rows(spark, d):
    used, total = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 10.0), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 3) * 150.0)
    return load(spark, d, "part").select("p_partkey", labels.memory_free(used, total).alias("free"), F.round(labels.memory_percent(used, total), 6).alias("percent"))


def contract_violations(spark, d):
    """What the events' properties break of a contract."""
    e = load(spark, d, "events").select(F.explode_outer(files.violations(F.col("props"), CONTRACT)).alias("violation"))
    return e.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("events"))


def hit_report(spark, d):
    """Search hits as rows of a CSV."""
    e = load(spark, d, "embeddings")
    hits = search.top_k(e, e.filter("vec_id = 3").first()["embedding"], k=25, exclude=3)
    return reports.hit_rows(hits.select("rank", "vec_id", F.round("similarity", 6).alias("similarity"), F.array(F.col("label"), F.col("label") + 1).alias("labels")))


def embedded_items(spark, d):
    """The brands' vectors by a stand-in for a model: dimension and length of each."""
    brands = load(spark, d, "part").select(F.col("p_brand").alias("item"), F.col("p_brand").alias("payload")).distinct()
    found = indexing.embed(brands, indexing.HashBackend)
    return found.select("item", F.size("vector").alias("dimension"), F.round(F.sqrt(search.dot("vector", "vector")), 4).alias("length"))


def _stream(spark, d):
    schema = load(spark, d, "events").schema.simpleString()[7:-1].replace(":", " ")
    return events.read_events(spark, f"{d}/events.parquet*", schema)


def events_stream_windows(spark, d):
    """The stream's hourly windows, which equal those of the table."""
    out = events.drained(events.windows(_stream(spark, d), ["event_type"], size="1 hour", late="3650 days"), "windows", "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def events_stream_dedupe(spark, d):
    """Each user's first event of a type that the stream sees, by number of users."""
    out = events.drained(events.once(_stream(spark, d), ["user_id", "event_type"], "3650 days"), "once")
    return out.groupBy("event_type").agg(F.count("*").alias("users"), F.count_distinct("user_id").alias("different"))


def events_stream_ordered(spark, d):
    """The stream's events that an hour has passed, each user's in the order of time with their place."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    state.use_state_store(spark)
    try:
        out = events.drained(state.ordered(_stream(spark, d), ["user_id"], ["event_type"], late="1 hour"), "ordered")
    finally:
        spark.conf.set(name, before)
    return out.select("user_id", "event_id", "event_type", "place")


QUERIES = {f.__name__: f for f in (loop_tempos, window_starts, version_numbers, number_formats, source_labels, memory_rows, contract_violations, hit_report, embedded_items, events_stream_windows, events_stream_dedupe, events_stream_ordered)}
SQL = {
    "loop_tempos": """WITH p AS (SELECT p_partkey, 60 + p_size * 1.7::DOUBLE AS b, 4 + (p_partkey % 60) * 0.5::DOUBLE AS s FROM part),
        c AS (SELECT p_partkey, b, s, r, n, b * r AS tempo, abs(s * (b * r) / 60.0::DOUBLE - n) AS e
              FROM p, (VALUES (0.5::DOUBLE), (0.6666666666666666::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) x(r), (VALUES (8), (16), (32), (64), (128)) y(n)),
        k AS (SELECT p_partkey, arg_min(n, (e / n, e, abs(r - 1), tempo, n)) AS n, arg_min(e, (e / n, e, abs(r - 1), tempo, n)) AS e FROM c WHERE tempo BETWEEN 45 AND 240 GROUP BY p_partkey)
        SELECT p_partkey, round(CASE WHEN s <= 30 AND e <= 0.25 AND e / n <= 0.005::DOUBLE AND n * 60.0::DOUBLE / s BETWEEN 45 AND 240 THEN n * 60.0::DOUBLE / s ELSE b END, 6) AS bpm FROM p LEFT JOIN k USING (p_partkey)""",
    "window_starts": """WITH n AS (SELECT doc_id, coalesce(n_chars, 0) - 500 AS last FROM documents), m AS (SELECT doc_id, last, least(5, last + 1) AS n FROM n),
        s AS (SELECT DISTINCT doc_id, CASE WHEN last <= 0 THEN 0 ELSE floor(i * last::DOUBLE / greatest(n - 1, 1))::BIGINT END AS start FROM (SELECT *, unnest(range(0, greatest(n, 1))) AS i FROM m))
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS place, start FROM s""",
    "version_numbers": """WITH v AS (SELECT p_partkey, list_transform(regexp_extract_all(p_size || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 2 = 0 THEN 'rc' || (p_partkey % 3) ELSE '' END, '\\d+'), lambda x: x::INT) || [0, 0, 0] AS v FROM part)
        SELECT p_partkey, v[1] AS major, v[2] AS minor, v[3] AS patch FROM v""",
    "number_formats": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(printf('%.8f', x), '.', ',') WHEN 1 THEN printf('%.8f', x) ELSE CASE WHEN x = floor(x) THEN floor(x)::BIGINT::VARCHAR ELSE printf('%.8f', x) END END AS text
        FROM (SELECT p_partkey, floor(p_retailprice) + CASE WHEN p_partkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END AS x FROM part)""",
    "source_labels": """SELECT p_partkey, concat_ws(' | ', 'WAV ' || p_type, ['44.1', '48', '22.05'][p_partkey % 3 + 1] || ' kHz', CASE WHEN p_partkey % 4 <> 0 THEN (8 + 8 * (p_partkey % 3)) || '-bit' END,
          ['mono', 'stereo', '3 channels', '4 channels'][p_partkey % 4 + 1],
          CASE WHEN p_partkey % 5 <> 0 THEN round_even([44100, 48000, 22050][p_partkey % 3 + 1] * (p_partkey % 4 + 1) * (CASE WHEN p_partkey % 4 <> 0 THEN 8 + 8 * (p_partkey % 3) ELSE 16 END) / 1000.0::DOUBLE, 0)::BIGINT || ' kbps' END) AS label,
        'path:' || sha256(p_name) AS path_id FROM part""",
    "memory_rows": """SELECT p_partkey, CASE WHEN total IS NOT NULL AND used IS NOT NULL THEN greatest(0, total - used) END AS free, round(CASE WHEN total <> 0 THEN 100.0::DOUBLE * used / total END, 6) AS percent FROM (
        SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size * 10.0::DOUBLE END AS used, CASE WHEN p_size % 5 <> 0 THEN (p_size % 3) * 150.0::DOUBLE END AS total FROM part)""",
    "contract_violations": """SELECT CASE WHEN k IS NULL THEN '$: lacks k' WHEN k < 30 THEN '$.k: is below 30' WHEN k > 70 THEN '$.k: is above 70' ELSE 'none' END AS violation, count(*) AS events
        FROM (SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
    "hit_report": """SELECT rank, vec_id, printf('%.9f', round(s, 6)) AS similarity, label || ' | ' || (label + 1) AS labels FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM (
        SELECT a.vec_id, a.label, list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS s FROM embeddings a, embeddings b WHERE b.vec_id = 3 AND a.vec_id <> 3)) WHERE rank <= 25""",
    "embedded_items": "SELECT DISTINCT p_brand AS item, 16::INT AS dimension, 1.0::DOUBLE AS length FROM part",
    "events_stream_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_stream_dedupe": "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS different FROM events GROUP BY event_type",
    "events_stream_ordered": """SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS place FROM events
        WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)""",
}
