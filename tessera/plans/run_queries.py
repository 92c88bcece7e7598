"""Queries over versioned runs. ``orders`` stand for runs: the customer is the
track, the date the time, the order key the ingest sequence, the status the
version, the priority the mode, and the price a tempo-like number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels, verdicts
from tessera.operators import latest as runs
from tessera.sources.tables import load

ORDER = ["o_orderdate", "o_orderkey"]
LATEST_SQL = "row_number() OVER (PARTITION BY {keys} ORDER BY o_orderdate DESC, o_orderkey DESC)::INT"


def latest_run_per_track(spark, d):
    return runs.latest(load(spark, d, "orders"), ["o_custkey"], ORDER).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


def top2_runs_per_track(spark, d):
    return runs.latest(load(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ORDER, 2).select("o_custkey", "o_orderstatus", "o_orderkey", "rn")


def catalog_with_latest(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    joined = runs.with_latest(c, o, F.col("c_custkey") == F.col("o_custkey"), ["o_custkey"], ORDER)
    return joined.select("c_custkey", "c_name", "o_orderkey", F.coalesce("o_orderstatus", F.lit("MISSING")).alias("state"))


def repeatability_pairs(spark, d):
    """The newest and the previous run of each track and version."""
    two = runs.latest(load(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ORDER, 2)
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    found = two.groupBy("o_custkey", "o_orderstatus").agg(pick("o_orderkey", 1).alias("newest"), pick("o_orderkey", 2).alias("previous"), pick("o_totalprice", 1).alias("a"), pick("o_totalprice", 2).alias("b"))
    return found.filter("previous is not null").select("o_custkey", "o_orderstatus", "newest", "previous", labels.tempo_relation("a", "b").alias("relation"))


def _version_pairs(spark, d) -> DataFrame:
    values = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    return runs.pairs_of(load(spark, d, "orders"), "o_custkey", "o_orderstatus", "F", "O", values, ORDER)


def version_pairs(spark, d):
    return _version_pairs(spark, d).select("o_custkey", F.col("l.o_orderkey").alias("left_run"), F.col("r.o_orderkey").alias("right_run"), labels.tempo_relation("l.o_totalprice", "r.o_totalprice").alias("relation"))


def _graded(pairs: DataFrame) -> DataFrame:
    """The ladder over pairs of runs: the mode stands for the family, its first
    letter for the classification, and prices for tempo and divergence."""
    a, b = F.col("l.o_totalprice"), F.col("r.o_totalprice")
    js = F.abs(a - b) / (a + b)
    level, reason = verdicts.severity(
        broad_match=F.col("l.o_orderpriority") == F.col("r.o_orderpriority"),
        both_high=F.substring("l.o_orderpriority", 1, 1).isin("1", "2") & F.substring("r.o_orderpriority", 1, 1).isin("1", "2"),
        js=js,
        class_match=(F.col("l.o_orderkey") % 2) == (F.col("r.o_orderkey") % 2),
        tempo=labels.tempo_relation(a, b),
        resolved_match=(F.col("l.o_orderkey") % 3) == (F.col("r.o_orderkey") % 3),
        key_match=F.when(F.col("l.o_orderkey") % 5 != 0, (F.col("l.o_orderkey") % 7) == (F.col("r.o_orderkey") % 7)),
        overlap=F.least(a, b) / F.greatest(a, b),
    )
    return pairs.select("o_custkey", level.alias("severity"), reason.alias("reason"))


def _severities(spark, d) -> DataFrame:
    return _graded(_version_pairs(spark, d))


def recheck_session(spark, d):
    """A session's summary: the tracks that are due are compared with their previous run."""
    values = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    two = runs.latest(load(spark, d, "orders"), ["o_custkey"], ORDER, 2)
    pick = lambda n: F.max(F.when(F.col("rn") == n, F.struct(*values)))
    pairs = two.groupBy("o_custkey").agg(pick(1).alias("l"), pick(2).alias("r"))
    due = verdicts.should_recheck("unstable", "O", version=F.lit("O"), confidence=F.when(F.col("l.o_orderpriority") == "1-URGENT", "high").otherwise("medium"), classification=F.when(F.col("l.o_orderkey") % 4 == 0, "hybrid"), worst=F.lit(None).cast("string"))
    own = pairs.filter(due)
    graded = _graded(own.filter("r is not null"))
    level = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    compared = graded.agg(F.count("*").alias("compared"), *[level(s) for s in labels.SEVERITIES], F.round(100.0 * F.count_if(F.col("severity").isin("STABLE", "MINOR")) / F.count("*"), 4).alias("consistent_pct"))
    return own.agg(F.count("*").alias("due"), F.count_if(F.col("r").isNull()).alias("first_runs")).join(compared)  # one row each


def severity_ladder(spark, d):
    return _severities(spark, d)


def severity_histogram(spark, d):
    """Counts of every severity, also of those that don't occur."""
    counts = _severities(spark, d).groupBy("severity").agg(F.count("*").alias("tracks"))
    domain = spark.createDataFrame([(s, i) for i, s in enumerate(labels.SEVERITIES)], "severity string, severity_order int")
    return domain.join(counts, "severity", "left").select("severity", "severity_order", F.coalesce("tracks", F.lit(0)).alias("tracks"))


def version_summary(spark, d):
    found = _severities(spark, d).join(_version_pairs(spark, d), "o_custkey")
    same = F.col("l.o_orderpriority") == F.col("r.o_orderpriority")
    known = F.col("l.o_orderkey") % 5 != 0
    keys = known & ((F.col("l.o_orderkey") % 7) == (F.col("r.o_orderkey") % 7))
    worst = F.max_by("severity", F.struct(labels.ordinal("severity", labels.SEVERITIES), (-F.col("o_custkey")).alias("o")))
    return found.agg(F.count("*").alias("compared"), F.round(100.0 * F.count_if(same) / F.count("*"), 4).alias("family_match_pct"), F.round(100.0 * F.count_if(keys) / F.count_if(known), 4).alias("key_match_pct"), worst.alias("worst"))


def mode_pairs(spark, d):
    """For each track all pairs of modes, each with its latest run."""
    last = runs.latest(load(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ORDER).select("o_custkey", F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("tempo"))
    other = last.select("o_custkey", F.col("mode").alias("right_mode"), F.col("tempo").alias("right_tempo"))
    pairs = last.join(other, "o_custkey").filter("mode < right_mode")
    return pairs.select("o_custkey", F.col("mode").alias("left_mode"), "right_mode", labels.tempo_relation("tempo", "right_tempo").alias("relation"))


def mode_convergence(spark, d):
    """The worst relation among each track's modes, as a level."""
    rank = F.when(F.col("relation") == "same", 0).when(F.col("relation") == "half-double", 1).otherwise(2)
    worst = mode_pairs(spark, d).groupBy("o_custkey").agg(F.max(rank).alias("w"), F.count("*").alias("pairs"))
    return worst.select("o_custkey", "pairs", verdicts.convergence_level(F.element_at(F.array(*[F.lit(s) for s in labels.SEVERITIES]), F.col("w") + 1)).alias("level"))


def build_registry(spark, d):
    """Distinct builds (version and mode; null and empty are one) with the latest time and its run."""
    o = load(spark, d, "orders")
    key = [F.coalesce("o_orderstatus", F.lit("")).alias("version"), F.coalesce("o_orderpriority", F.lit("")).alias("mode")]
    return o.groupBy(*key).agg(F.count("*").alias("runs"), F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_run"))


def build_coverage(spark, d):
    return runs.coverage(load(spark, d, "orders"), "o_custkey", "o_orderstatus", "F", "P")


def duplicate_runs(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("runs")).filter("runs > 1")


def scoped_snapshot(spark, d):
    where = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return runs.scoped(load(spark, d, "orders"), where, "o_custkey", ORDER, "latest").select("o_custkey", "o_orderkey", "o_totalprice")


def upserted_runs(spark, d):
    """A table after changes: the P runs are the table, the F runs the changes."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    after = runs.upsert(o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'F'"), ["o_custkey"], ORDER)
    return after.select("o_custkey", "o_orderkey", "o_orderstatus")


def recheck_due(spark, d):
    """Tracks whose latest run is old or unsure."""
    last = runs.latest(load(spark, d, "orders"), ["o_custkey"], ORDER)
    sure = F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("medium")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "hybrid").otherwise("primary")
    common = {"version": F.col("o_orderstatus"), "confidence": sure, "classification": kind, "worst": F.lit("STABLE")}
    return last.select("o_custkey", verdicts.should_recheck("old_versions", "O", **common).alias("old"), verdicts.should_recheck("unstable", "O", **common).alias("unstable"))


def status_counts_rollup(spark, d):
    o = load(spark, d, "orders").select(F.coalesce("o_orderstatus", F.lit("NULL")).alias("status"), F.coalesce("o_orderpriority", F.lit("NULL")).alias("mode"))
    return o.rollup("status", "mode").agg(F.count("*").alias("runs"))


def run_gap_days(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gaps = load(spark, d, "orders").withColumn("gap", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)))
    return gaps.groupBy("o_custkey").agg(F.count("gap").alias("gaps"), F.percentile("gap", F.lit(0.5)).alias("p50"), F.percentile("gap", F.lit(0.95)).alias("p95"))


_RELATION = """CASE WHEN coalesce({a}, 0) <= 0 OR coalesce({b}, 0) <= 0 THEN 'unknown'
 WHEN abs({a} - {b}) <= greatest(1.0, 0.025 * greatest({a}, {b})) THEN 'same'
 WHEN abs({a} * 2 - {b}) <= greatest(1.0, 0.025 * greatest({a} * 2, {b})) OR abs({a} - {b} * 2) <= greatest(1.0, 0.025 * greatest({a}, {b} * 2)) THEN 'half-double'
 ELSE 'different' END"""


def relation_sql(a: str, b: str) -> str:
    return _RELATION.format(a=a, b=b).replace("0.025", "0.025::DOUBLE").replace("greatest(1.0,", "greatest(1.0::DOUBLE,")


_LATEST_BY = "SELECT *, " + LATEST_SQL.format(keys="o_custkey, {k}") + " AS rn FROM orders"
_PAIRS = f"""WITH v AS ({_LATEST_BY.format(k="o_orderstatus")}), p AS (
  SELECT l.o_custkey, l.o_orderkey AS lk, r.o_orderkey AS rk, l.o_orderpriority AS lp, r.o_orderpriority AS rp, l.o_totalprice AS a, r.o_totalprice AS b
  FROM v l JOIN v r ON l.o_custkey = r.o_custkey WHERE l.rn = 1 AND r.rn = 1 AND l.o_orderstatus = 'F' AND r.o_orderstatus = 'O')"""
_RULES = [
    ("lp <> rp AND left(lp, 1) IN ('1', '2') AND left(rp, 1) IN ('1', '2')", "CRITICAL", "both verdicts are sure and name different families"),
    ("abs(a - b) / (a + b) >= 0.45::DOUBLE", "CRITICAL", "family distributions lie very far apart"),
    ("lp <> rp", "SIGNIFICANT", "another family"),
    ("lk % 2 <> rk % 2", "SIGNIFICANT", "one verdict is primary, the other hybrid"),
    ("abs(a - b) / (a + b) >= 0.20::DOUBLE", "SIGNIFICANT", "family distributions lie far apart"),
    (relation_sql("a", "b") + " = 'different'", "SIGNIFICANT", "tempos are not equal, half or double"),
    ("lk % 3 <> rk % 3", "MINOR", "another style of the same family"),
    ("abs(a - b) / (a + b) >= 0.08::DOUBLE", "MINOR", "family distributions differ somewhat"),
    ("lk % 5 <> 0 AND lk % 7 <> rk % 7", "MINOR", "another key or mode"),
    ("least(a, b) / greatest(a, b) < 0.5::DOUBLE", "MINOR", "the best styles have little in common"),
]
_GRADED = ", s AS (SELECT *, CASE " + " ".join(f"WHEN {w} THEN '{s}'" for w, s, _ in _RULES) + " ELSE 'STABLE' END AS severity, CASE " + " ".join(f"WHEN {w} THEN '{r}'" for w, _, r in _RULES) + " ELSE 'the evidence agrees' END AS reason FROM p)"
_LADDER = _PAIRS + _GRADED
_SESSION = f"""WITH v AS (SELECT *, {LATEST_SQL.format(keys='o_custkey')} AS rn FROM orders), due AS (
  SELECT * FROM v WHERE rn = 1 AND (o_orderpriority <> '1-URGENT' OR o_orderkey % 4 = 0)
), p AS (
  SELECT l.o_custkey, l.o_orderkey AS lk, r.o_orderkey AS rk, l.o_orderpriority AS lp, r.o_orderpriority AS rp, l.o_totalprice AS a, r.o_totalprice AS b
  FROM due l JOIN v r ON l.o_custkey = r.o_custkey AND r.rn = 2)"""
_SEVERITY_VALUES = "(VALUES ('STABLE', 0), ('MINOR', 1), ('SIGNIFICANT', 2), ('CRITICAL', 3))"
_MODES = f"""WITH m AS ({_LATEST_BY.format(k="o_orderpriority")}), p AS (
  SELECT l.o_custkey, l.o_orderpriority AS left_mode, r.o_orderpriority AS right_mode, {relation_sql("l.o_totalprice", "r.o_totalprice")} AS relation
  FROM m l JOIN m r ON l.o_custkey = r.o_custkey AND l.o_orderpriority < r.o_orderpriority WHERE l.rn = 1 AND r.rn = 1)"""

QUERIES = {f.__name__: f for f in (latest_run_per_track, top2_runs_per_track, catalog_with_latest, repeatability_pairs, version_pairs, severity_ladder, severity_histogram, version_summary, mode_pairs, mode_convergence, build_registry, build_coverage, duplicate_runs, scoped_snapshot, upserted_runs, recheck_due, recheck_session, status_counts_rollup, run_gap_days)}
SQL = {
    "latest_run_per_track": f"SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, {LATEST_SQL.format(keys='o_custkey')} AS rn FROM orders) WHERE rn = 1",
    "top2_runs_per_track": f"SELECT o_custkey, o_orderstatus, o_orderkey, rn FROM ({_LATEST_BY.format(k='o_orderstatus')}) WHERE rn <= 2",
    "catalog_with_latest": f"SELECT c_custkey, c_name, o_orderkey, coalesce(o_orderstatus, 'MISSING') AS state FROM customer LEFT JOIN (SELECT *, {LATEST_SQL.format(keys='o_custkey')} AS rn FROM orders) o ON c_custkey = o_custkey AND rn = 1",
    "repeatability_pairs": f"WITH v AS ({_LATEST_BY.format(k='o_orderstatus')}) SELECT l.o_custkey, l.o_orderstatus, l.o_orderkey AS newest, r.o_orderkey AS previous, {relation_sql('l.o_totalprice', 'r.o_totalprice')} AS relation FROM v l JOIN v r ON l.o_custkey = r.o_custkey AND l.o_orderstatus = r.o_orderstatus AND l.rn = 1 AND r.rn = 2",
    "version_pairs": _PAIRS + f" SELECT o_custkey, lk AS left_run, rk AS right_run, {relation_sql('a', 'b')} AS relation FROM p",
    "severity_ladder": _LADDER + " SELECT o_custkey, severity, reason FROM s",
    "severity_histogram": _LADDER + f" SELECT d.severity, d.severity_order, count(s.severity) AS tracks FROM {_SEVERITY_VALUES} d(severity, severity_order) LEFT JOIN s USING (severity) GROUP BY ALL",
    "version_summary": _LADDER + f""" SELECT count(*) AS compared, round(100.0::DOUBLE * count(*) FILTER (lp = rp) / count(*), 4) AS family_match_pct,
        round(100.0::DOUBLE * count(*) FILTER (lk % 5 <> 0 AND lk % 7 = rk % 7) / count(*) FILTER (lk % 5 <> 0), 4) AS key_match_pct,
        arg_max(severity, (d.severity_order, -o_custkey)) AS worst FROM s JOIN {_SEVERITY_VALUES} d(severity, severity_order) USING (severity)""",
    "mode_pairs": _MODES + " SELECT o_custkey, left_mode, right_mode, relation FROM p",
    "mode_convergence": _MODES + " SELECT o_custkey, count(*) AS pairs, CASE max(CASE relation WHEN 'same' THEN 0 WHEN 'half-double' THEN 1 ELSE 2 END) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p GROUP BY o_custkey",
    "build_registry": "SELECT coalesce(o_orderstatus, '') AS version, coalesce(o_orderpriority, '') AS mode, count(*) AS runs, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_run FROM orders GROUP BY 1, 2",
    "build_coverage": """WITH f AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS l, bool_or(o_orderstatus = 'P') AS r FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_custkey)
        SELECT count(*) FILTER (l) AS left_total, count(*) FILTER (r) AS right_total, count(*) FILTER (l AND r) AS common, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only FROM f""",
    "duplicate_runs": "SELECT o_custkey, o_orderdate, count(*) AS runs FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "scoped_snapshot": f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, {LATEST_SQL.format(keys='o_custkey')} AS rn FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') WHERE rn = 1",
    "upserted_runs": f"SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, {LATEST_SQL.format(keys='o_custkey')} AS rn FROM orders WHERE o_orderstatus IN ('F', 'P')) WHERE rn = 1",
    "recheck_due": f"SELECT o_custkey, o_orderstatus <> 'O' AS old, o_orderpriority <> '1-URGENT' OR o_orderkey % 4 = 0 AS unstable FROM (SELECT *, {LATEST_SQL.format(keys='o_custkey')} AS rn FROM orders) WHERE rn = 1",
    "recheck_session": _SESSION + _GRADED + """ SELECT (SELECT count(*) FROM due) AS due, (SELECT count(*) FROM due) - count(*) AS first_runs, count(*) AS compared,
        count(*) FILTER (severity = 'STABLE') AS stable, count(*) FILTER (severity = 'MINOR') AS minor, count(*) FILTER (severity = 'SIGNIFICANT') AS significant, count(*) FILTER (severity = 'CRITICAL') AS critical,
        round(100.0::DOUBLE * count(*) FILTER (severity IN ('STABLE', 'MINOR')) / count(*), 4) AS consistent_pct FROM s""",
    "status_counts_rollup": "SELECT coalesce(o_orderstatus, 'NULL') AS status, coalesce(o_orderpriority, 'NULL') AS mode, count(*) AS runs FROM orders GROUP BY ROLLUP (1, 2)",
    "run_gap_days": """WITH g AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::DATE, o_orderdate::DATE) AS gap FROM orders)
        SELECT o_custkey, count(gap) AS gaps, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.95) AS p95 FROM g GROUP BY o_custkey""",
}
