"""Queries over event logs, time windows and ordered turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.quantiles import percentiles
from tessera.sources.tables import load


def _events(spark, d):
    return load(spark, d, "events")


def events_tumbling(spark, d):
    e = _events(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    return e.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def events_hopping(spark, d):
    """Counts in windows of one hour that start every half hour."""
    start = F.floor(F.unix_timestamp("ts") / 1800)
    e = _events(spark, d).select("event_type", F.explode(F.array(start, start - 1)).alias("slot"))
    return e.groupBy((F.col("slot") * 1800).alias("start_s"), "event_type").agg(F.count("*").alias("n"))


def events_session(spark, d):
    """Sessions by user: runs of events with gaps of under half an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    marked = _events(spark, d).withColumn("new", F.when(gap.isNull() | (gap >= 1_800_000_000), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def events_gap_stats(spark, d):
    """Gaps between a user's events: median, p95, quartile range and coefficient of variation."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    g = _events(spark, d).withColumn("gap", gap).filter("gap is not null").select("user_id", "gap")
    middle = percentiles(g, ["user_id"], "gap", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    spread = g.groupBy("user_id").agg(F.stddev_pop("gap").alias("s"), F.avg("gap").alias("m"))
    cv = F.when((F.col("n") >= 2) & (F.abs("m") > 1e-12), F.col("s") / F.abs("m"))
    return middle.join(spread, "user_id").select("user_id", F.col("n").alias("gaps"), F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), F.round(F.col("p75") - F.col("p25"), 4).alias("iqr"), F.round(cv, 6).alias("cv"))


def events_cumulative_rolloff(spark, d):
    """For each event type the hour by which 85 % of its value has come."""
    hours = _events(spark, d).groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    w = Window.partitionBy("event_type")
    run = F.sum("v").over(w.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return hours.withColumn("run", run).withColumn("all", F.sum("v").over(w)).filter(F.col("run") >= 0.85 * F.col("all")).groupBy("event_type").agg(F.min("hour").alias("rolloff_hour"))


def events_json_props(spark, d):
    k = labels.optional_float(F.get_json_object("props", "$.k"))
    e = _events(spark, d).select("event_type", k.alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.round(F.avg("k"), 6).alias("mean_k"))


def access_summary(spark, d):
    """For each user the last event, and the last of each family of types."""
    kind = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts"))).alias(f"last_{t}")
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), last, kind("view"), kind("purchase"))


def event_sign_changes(spark, d):
    """How often the value crosses its type's mean from one event of the type to the
    next. Events are compared within hours; only each hour's first and last side
    go on, so that no task sorts all events of a type."""
    e = _events(spark, d).select("event_type", "event_id", "ts", "value", F.date_trunc("hour", "ts").alias("hour"))
    means = e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    side = e.join(means, "event_type").withColumn("above", F.round("value", 4) >= F.col("mean"))
    side = side.withColumn("before", F.lag("above").over(Window.partitionBy("event_type", "hour").orderBy("ts", "event_id")))
    at = F.struct("ts", "event_id")
    hours = side.groupBy("event_type", "hour").agg(F.count_if(F.col("above") != F.col("before")).alias("crossings"), F.count("before").alias("steps"), F.min_by("above", at).alias("first"), F.max_by("above", at).alias("last"))
    hours = hours.withColumn("previous", F.lag("last").over(Window.partitionBy("event_type").orderBy("hour")))
    between = F.coalesce((F.col("first") != F.col("previous")).cast("long"), F.lit(0))
    return hours.groupBy("event_type").agg(F.sum(F.col("crossings") + between).alias("crossings"), F.sum(F.col("steps") + F.col("previous").isNotNull().cast("long")).alias("steps"))


def evidence_after_request(spark, d):
    """For each user the events strictly after the latest purchase, and whether one at its very time makes the order unsure."""
    e = _events(spark, d)
    request = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("request"))
    rows = e.join(request, "user_id").filter(F.col("event_id") != F.col("request.event_id"))
    after = F.col("ts") > F.col("request.ts")
    found = rows.groupBy("user_id").agg(F.count_if(after).alias("after"), F.count_if(F.col("ts") == F.col("request.ts")).alias("same_time"), F.min_by("event_id", F.when(after, F.struct("ts", "event_id"))).alias("first_after"))
    state = F.when(F.col("same_time") > 0, "AMBIGUOUS").when(F.col("after") > 0, "ANSWERED").otherwise("OPEN")
    return request.join(found, "user_id", "left").select("user_id", F.coalesce("after", F.lit(0)).alias("after"), "first_after", F.when(F.col("after").isNull(), "OPEN").otherwise(state).alias("state"))


def latency_percentiles(spark, d):
    """Median and 95th percentile of the values of each type, interpolated."""
    found = percentiles(_events(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, small=1000)
    return found.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def top_events_by_value(spark, d):
    """The 64 greatest events of each type, in the order of time."""
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    top = _events(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 64")
    return top.select("event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).alias("place"), "event_id")


def turn_gaps(spark, d):
    c = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return c.withColumn("before", F.lag("role").over(w)).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == F.col("before")).alias("same_role"), F.max("turn").alias("last_turn"))


def latest_turn(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), "role", "text")
    return load(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("conv_id", "turn", "role")


QUERIES = {f.__name__: f for f in (events_tumbling, events_hopping, events_session, events_gap_stats, events_cumulative_rolloff, events_json_props, access_summary, event_sign_changes, evidence_after_request, latency_percentiles, top_events_by_value, turn_gaps, latest_turn)}
_GAP = "(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))"
SQL = {
    "events_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_hopping": "SELECT slot * 1800 AS start_s, event_type, count(*) AS n FROM (SELECT event_type, unnest([s, s - 1]) AS slot FROM (SELECT event_type, epoch_us(ts) // 1800000000 AS s FROM events)) GROUP BY 1, 2",
    "events_session": f"""SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM (
        SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, {_GAP} AS gap FROM events)) GROUP BY 1, 2""",
    "events_gap_stats": f"""SELECT user_id, count(*) AS gaps, round(quantile_cont(gap, 0.5), 4) AS median, round(quantile_cont(gap, 0.95), 4) AS p95, round(quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25), 4) AS iqr,
        round(CASE WHEN count(*) >= 2 AND abs(avg(gap)) > 1e-12 THEN stddev_pop(gap) / abs(avg(gap)) END, 6) AS cv FROM (SELECT user_id, {_GAP} / 1e6::DOUBLE AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id""",
    "events_cumulative_rolloff": """WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, sum(round(value * 100)::BIGINT) AS v FROM events GROUP BY 1, 2),
        r AS (SELECT *, sum(v) OVER (PARTITION BY event_type ORDER BY hour) AS run, sum(v) OVER (PARTITION BY event_type) AS total FROM h)
        SELECT event_type, min(hour) AS rolloff_hour FROM r WHERE run >= 0.85 * total GROUP BY event_type""",
    "events_json_props": "SELECT event_type, count(*) AS n, count(k) AS with_k, round(avg(k), 6) AS mean_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type",
    "access_summary": "SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) FILTER (event_type = 'view') AS last_view, max(ts) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id",
    "event_sign_changes": """WITH m AS (SELECT *, round(value, 4) >= round(avg(value) OVER (PARTITION BY event_type), 4) AS above FROM events),
        b AS (SELECT *, lag(above) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM m)
        SELECT event_type, count(*) FILTER (above <> before) AS crossings, count(before) AS steps FROM b GROUP BY event_type""",
    "evidence_after_request": """WITH r AS (SELECT user_id, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE event_type = 'purchase' GROUP BY user_id),
        f AS (SELECT e.user_id, count(*) FILTER (ts > t) AS after, count(*) FILTER (ts = t) AS same, arg_min(event_id, (ts, event_id)) FILTER (ts > t) AS first_after FROM events e JOIN r USING (user_id) WHERE event_id <> id GROUP BY e.user_id)
        SELECT user_id, coalesce(after, 0) AS after, first_after, CASE WHEN same > 0 THEN 'AMBIGUOUS' WHEN after > 0 THEN 'ANSWERED' ELSE 'OPEN' END AS state FROM r LEFT JOIN f USING (user_id)""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "top_events_by_value": """SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS place, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 64""",
    "turn_gaps": """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = before) AS same_role, max(turn) AS last_turn FROM (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) GROUP BY conv_id""",
    "latest_turn": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) WHERE rn = 1",
}
