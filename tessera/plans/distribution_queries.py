"""Queries over label distributions. Line items stand for scored labels: the
part's type is the family, its brand the style, the order the window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels, verdicts
from tessera.operators import distributions as dist
from tessera.sources.shared import written
from tessera.sources.tables import load


def _scores(spark, d) -> DataFrame:
    """``status, window, pos, label, score``: what each order's lines say."""
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    p = load(spark, d, "part").select("p_partkey", F.concat_ws(labels.SEPARATOR, "p_type", "p_brand").alias("label"))
    i = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("pos"), F.round(F.col("l_quantity") / 50, 6).alias("score"))
    return i.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("status", F.col("l_orderkey").alias("window"), "pos", "label", "score")


_SCORES = """scores AS (
  SELECT o_orderstatus AS status, l_orderkey AS window_id, l_linenumber AS pos, p_type || '---' || p_brand AS label, round(l_quantity / 50, 6) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
), firsts AS (
  SELECT status, window_id, label, arg_min(score, (pos, score)) AS s FROM scores GROUP BY ALL
), n AS (
  SELECT status, count(DISTINCT window_id) AS n FROM scores GROUP BY status
), styles AS (
  SELECT f.status, label, sum(greatest(s, 0)) / any_value(n.n) AS score FROM firsts f JOIN n USING (status) GROUP BY f.status, label
), families AS (
  SELECT status, split_part(label, '---', 1) AS label, sum(score) AS score FROM styles GROUP BY ALL
)"""


def _styles(spark, d) -> DataFrame:
    return dist.reduce_windows(_scores(spark, d), ["status"], "window", top=None)


def _families(spark, d) -> DataFrame:
    return _families_of(_styles(spark, d))


def _families_of(styles: DataFrame) -> DataFrame:
    out = styles.groupBy("status", labels.family_of("label").alias("label")).agg(F.sum("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.round("score", 9).desc(), "label")))


def label_distribution(spark, d):
    w = Window.partitionBy("status").orderBy(F.round("score", 9).desc(), "label")
    return _styles(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 15").select("status", "label", "rank", F.round("score", 6).alias("score"))


def family_rollup(spark, d):
    return dist.shares(_families(spark, d), ["status"], "score").select("status", "label", "rank", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


def distribution_drift(spark, d):
    """Cosine, divergence and top overlap of the families of every pair of statuses."""
    families = written(_families(spark, d), "families")  # a row for each status and family, used on both sides of each pair
    own = dist.shares(families, ["status"], "score").select("status", "label", "share", "rank")
    pairs = own.select("status").distinct().withColumnRenamed("status", "a").join(own.select(F.col("status").alias("b")).distinct(), F.col("a") < F.col("b"))
    side = lambda which: pairs.join(own, F.col(which) == F.col("status")).select("a", "b", "label", "share", "rank")
    left, right = side("a"), side("b")
    found = dist.drift(left, right, ["a", "b"]).join(dist.rank_overlap(left, right, ["a", "b"], top=3), ["a", "b"])
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("cosine", "js", "overlap")])


def resolve_top2_family(spark, d):
    """The verdict on each brand's lines by type, and on each status."""
    ranked = lambda rows, n: rows.filter(F.col("rank") <= n).groupBy("status").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label", "score"))), lambda s: F.struct(s["label"].alias("label"), F.round(s["score"], 9).alias("score"))).alias("x"))
    scores = written(_styles(spark, d), "styles")  # a row for each status and style
    styles = scores.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.round("score", 9).desc(), "label")))
    both = ranked(styles, 15).withColumnRenamed("x", "styles").join(ranked(_families_of(scores), 15).withColumnRenamed("x", "families"), "status")
    out = verdicts.resolve(both)
    return out.select("status", "resolved", "classification", "confidence", "primary_family", "secondary_family", "secondary_style", *[F.round(c, 5).alias(c) for c in ("family_margin", "family_ratio", "style_margin")])


def fused_evidence(spark, d):
    """Families of the lines fused with those of the parts' market, which is a weaker source."""
    base = _families(spark, d).select("status", "label", "score")
    kinds = load(spark, d, "part").groupBy(F.col("p_type").alias("label")).agg((F.avg("p_size") / 1000).alias("score"))
    extra = base.select("status").distinct().join(kinds.filter("label <> 'ECONOMY'"), F.lit(True))  # a row for each status and type
    return dist.fuse(base, extra, ["status"]).select("status", "label", F.round("score", 6).alias("score"))


_RANKED = "row_number() OVER (PARTITION BY status ORDER BY round(score, 9) DESC, label)::INT"
_DRIFT = f"""WITH {_SCORES}, own AS (
  SELECT status, label, score / sum(score) OVER (PARTITION BY status) AS share, {_RANKED} AS rank FROM families
), st AS (SELECT DISTINCT status FROM own), pr AS (SELECT x.status AS a, y.status AS b FROM st x JOIN st y ON x.status < y.status),
l AS (SELECT a, b, label, share, rank FROM pr JOIN own ON status = a), r AS (SELECT a, b, label, share, rank FROM pr JOIN own ON status = b),
j AS (SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, coalesce(l.share, 0) AS x, coalesce(r.share, 0) AS y,
       CASE WHEN l.rank <= 3 THEN 1.0::DOUBLE / l.rank / (1 + 1 / 2.0::DOUBLE + 1 / 3.0::DOUBLE) ELSE 0 END AS wx,
       CASE WHEN r.rank <= 3 THEN 1.0::DOUBLE / r.rank / (1 + 1 / 2.0::DOUBLE + 1 / 3.0::DOUBLE) ELSE 0 END AS wy
      FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.label = r.label)
SELECT a, b, round(least(1, sum(x * y) / sqrt(sum(x * x) * sum(y * y))), 6) AS cosine,
       round(greatest(0, sum(CASE WHEN x > 0 THEN x * ln(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * ln(y / ((x + y) / 2)) ELSE 0 END) / 2 / ln(2)), 6) AS js,
       round(sum(least(wx, wy)), 6) AS overlap
FROM j GROUP BY a, b"""
_RESOLVE = f"""WITH {_SCORES}, s AS (SELECT status, label, split_part(label, '---', 1) AS fam, split_part(label, '---', 2) AS leaf, round(score, 9) AS score, {_RANKED} AS rank FROM styles),
f AS (SELECT status, label, round(score, 9) AS score, {_RANKED} AS rank FROM families),
t AS (SELECT a.status, a.label AS f1, a.score AS s1, b.label AS f2, b.score AS s2, a.score - coalesce(b.score, 0) AS margin, b.score / a.score AS ratio
      FROM f a LEFT JOIN f b ON a.status = b.status AND b.rank = 2 WHERE a.rank = 1),
c AS (SELECT *, f2 IS NOT NULL AND (margin < 0.08::DOUBLE OR ratio >= 0.8::DOUBLE) AS hybrid, margin < 0.2::DOUBLE OR ratio >= 0.65::DOUBLE AS medium FROM t),
k AS (SELECT c.status, min(s.rank) AS crank FROM c JOIN s ON s.status = c.status AND s.rank <= 15 AND (s.fam = f1 OR (hybrid AND s.fam = f2)) GROUP BY c.status),
v AS (SELECT c.status, min(s.rank) AS vrank FROM c LEFT JOIN k USING (status) JOIN s ON s.status = c.status AND s.rank <= 15 AND s.fam IN (f1, f2) AND s.rank IS DISTINCT FROM crank GROUP BY c.status),
w AS (SELECT c.*, cs.label AS cl, cs.leaf AS cleaf, cs.score AS cscore, vs.label AS vl, vs.leaf AS vleaf, vs.score AS vscore,
        coalesce(vs.score > cs.score AND vs.fam = f2, false) AS swap
      FROM c LEFT JOIN k USING (status) LEFT JOIN v USING (status) LEFT JOIN s cs ON cs.status = c.status AND cs.rank = crank LEFT JOIN s vs ON vs.status = c.status AND vs.rank = vrank),
x AS (SELECT *, CASE WHEN swap THEN vleaf ELSE cleaf END AS best, CASE WHEN swap THEN cleaf ELSE vleaf END AS other, hybrid OR swap AS h,
        CASE WHEN (CASE WHEN swap THEN cscore ELSE vscore END) IS NULL THEN CASE WHEN cscore IS NOT NULL THEN 1.0::DOUBLE END
             ELSE ((CASE WHEN swap THEN vscore ELSE cscore END) - (CASE WHEN swap THEN cscore ELSE vscore END)) / (CASE WHEN swap THEN vscore ELSE cscore END) END AS sm FROM w)
SELECT status, coalesce(best, f1) AS resolved, CASE WHEN h THEN 'hybrid' ELSE 'primary' END AS classification,
  CASE WHEN h THEN 'low-medium' WHEN NOT medium THEN CASE WHEN sm >= 0.35::DOUBLE THEN 'high' ELSE 'medium' END WHEN coalesce(sm, 0) < 0.15::DOUBLE THEN 'low-medium' ELSE 'medium' END AS confidence,
  f1 AS primary_family, f2 AS secondary_family, other AS secondary_style, round(round(margin, 6), 5) AS family_margin, round(round(ratio, 6), 5) AS family_ratio, round(round(sm, 6), 5) AS style_margin FROM x"""
_FUSED = f"""WITH {_SCORES}, a AS (SELECT status, label, score / sum(score) OVER (PARTITION BY status) AS a FROM families),
e AS (SELECT p_type AS label, avg(p_size) / 1000 AS score FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type),
b AS (SELECT label, score / sum(score) OVER () AS b FROM e), w AS (SELECT 0.25::DOUBLE * least(1, sum(score)) AS w FROM e),
g AS (SELECT status, b.label, b.b FROM (SELECT DISTINCT status FROM a), b)
SELECT coalesce(a.status, g.status) AS status, coalesce(a.label, g.label) AS label, round((1 - w.w) * coalesce(a, 0) + w.w * coalesce(g.b, 0), 6) AS score
FROM a FULL JOIN g ON a.status = g.status AND a.label = g.label, w"""

QUERIES = {f.__name__: f for f in (label_distribution, family_rollup, distribution_drift, resolve_top2_family, fused_evidence)}
SQL = {
    "label_distribution": f"WITH {_SCORES} SELECT status, label, rank, round(score, 6) AS score FROM (SELECT *, {_RANKED} AS rank FROM styles) WHERE rank <= 15",
    "family_rollup": f"WITH {_SCORES} SELECT status, label, {_RANKED} AS rank, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY status), 6) AS share FROM families",
    "distribution_drift": _DRIFT,
    "resolve_top2_family": _RESOLVE,
    "fused_evidence": _FUSED,
}
