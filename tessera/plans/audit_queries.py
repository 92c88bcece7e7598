"""Queries of coverage, integrity, sets, graphs, catalogs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import audit, graph, segments
from tessera.sources.tables import load


def coverage_missing(spark, d):
    """Documents without a label."""
    return audit.missing(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id").select("doc_id", "source")


def stale_rows(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return audit.stale(o, load(spark, d, "customer"), "c_custkey", F.col("o_orderstatus") == "O").groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


def index_status(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = audit.status(load(spark, d, "customer"), o, "c_custkey", F.col("o_orderstatus") == "P")
    return out.select("catalog_rows", "current_rows", "stale_rows", F.round("coverage", 6).alias("coverage"))


def current_ids(spark, d):
    """Customers with a current run."""
    c, o = load(spark, d, "customer"), load(spark, d, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


def fk_orphans(spark, d):
    """For each reference the child rows without a parent."""
    checks = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, a, parent, b in checks:
        one = audit.orphans(load(spark, d, child), load(spark, d, parent).select(b), a, b).agg(F.count("*").alias("orphans")).select(F.lit(f"{child}.{a}").alias("reference"), "orphans")
        out = one if out is None else out.union(one)
    return out


def set_ops(spark, d):
    """Customers of finished and of open orders: both, either, one alone."""
    o = load(spark, d, "orders")
    f, p = (o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "P"))
    parts = {"both": f.intersect(p), "either": f.union(p).distinct(), "left_only": f.subtract(p), "right_only": p.subtract(f)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("keys"), F.sum("o_custkey").alias("key_sum")).select(F.lit(name).alias("part"), "keys", "key_sum")
        out = one if out is None else out.unionByName(one)
    return out


def graph_reach(spark, d):
    """What follows from edges between nations of one region, each to the next two."""
    n = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("r"))
    edges = n.join(m, (F.col("n_regionkey") == F.col("r")) & (F.col("dst") > F.col("n_nationkey")) & (F.col("dst") <= F.col("n_nationkey") + 6)).select(F.col("n_nationkey").alias("src"), "dst")
    return graph.reach(edges)


def graph_cycles(spark, d):
    """Nations on a cycle of edges to three times their number, modulo 25."""
    n = load(spark, d, "nation")
    return graph.cycles(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3) % 25).alias("dst")))


def unlinked_nodes(spark, d):
    """The customers whom no edge leaves or reaches; every fifth order is an edge."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    edges = o.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") * 7 % 1000 + 1).alias("dst"))
    return audit.unlinked(load(spark, d, "customer").select("c_custkey"), edges, "c_custkey")


def dangling_choices(spark, d):
    """The parts that orders' lines name by number and the table of suppliers lacks, with how many lines do."""
    lines = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("s_suppkey")).agg(F.count("*").alias("lines"))
    return audit.dangling(lines, load(spark, d, "supplier"), "s_suppkey")


def param_diff_full_outer(spark, d):
    """Two snapshots of the parts' prices: one lacks every 97th, the other every 89th, and every 50th has changed."""
    p = load(spark, d, "part")
    base = p.filter("p_partkey % 97 <> 0").select("p_partkey", F.col("p_size").alias("v"))
    candidate = p.filter("p_partkey % 89 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return audit.differences(base, candidate, ["p_partkey"], "v")


def param_patch(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size")
    patch = p.filter("p_partkey % 10 = 0").select((F.col("p_partkey") + 5).alias("p_partkey"), (F.col("p_size") * 2).alias("p_size"))
    return audit.patched(p, patch, ["p_partkey"], "p_size")


def facet_filter_catalog(spark, d):
    """Suppliers and customers through all kinds of facets."""
    c, n, r = load(spark, d, "customer"), load(spark, d, "nation"), load(spark, d, "region")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    rows = rows.withColumn("path", F.concat_ws("/", "r_name", "n_name", "c_name")).withColumn("tags", F.array("c_mktsegment", "r_name"))
    where = labels.one_of("c_mktsegment", ["building", "machinery"]) & labels.within("c_acctbal", 0.0, 5000.0) & (labels.overlaps("tags", ["asia", "europe", "building"])) & (labels.in_folder("path", ["asia", "EUROPE/", "america\\"]))
    return rows.filter(where).select("c_custkey", "path")


def text_normalise(spark, d):
    t = load(spark, d, "documents")
    return t.select("doc_id", F.sha2(labels.collapse_space("text"), 256).alias("digest"), labels.safe_token(F.concat("source", F.lit("/x y"))).alias("token"), F.length(labels.compact("text")).alias("kept"))


def text_identity_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", labels.text_identity("text").alias("identity"), F.lower("lang").alias("lang"))


def content_duplicates(spark, d):
    """Equal contents: the first id, the rest, and how many rows they add."""
    t = load(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    groups = t.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("doc_id").alias("last_id"))
    return groups.filter("copies > 1").select("digest", "first_id", "last_id", (F.col("copies") - 1).alias("extra"))


def page_url_parts(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), labels.parent_folder("url").alias("folder"))


def segment_plan(spark, d):
    """Documents as media of a second for every ten characters."""
    t = load(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("seconds"))
    return segments.plan_segments(t, "seconds", window=30.0, hop=20.0, most=16).select("doc_id", "segment", "start_s", "end_s", "is_short")


def duration_policy(spark, d):
    t = load(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("s"))
    return t.select("doc_id", labels.input_quality("s").alias("quality"), labels.window_target("s").alias("windows"))


def catalog_report(spark, d):
    """Parts by type with shares of the whole, and of each brand by grouping sets."""
    p = load(spark, d, "part")
    g = p.rollup("p_type", "p_brand").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))
    return g.select(F.coalesce("p_type", F.lit("ALL")).alias("p_type"), F.coalesce("p_brand", F.lit("ALL")).alias("p_brand"), "parts", "mean_price")


QUERIES = {f.__name__: f for f in (coverage_missing, stale_rows, index_status, current_ids, fk_orphans, set_ops, graph_reach, graph_cycles, unlinked_nodes, dangling_choices, param_diff_full_outer, param_patch, facet_filter_catalog, text_normalise, text_identity_hash, content_duplicates, page_url_parts, segment_plan, duration_policy, catalog_report)}
_ORPHANS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]
SQL = {
    "coverage_missing": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "stale_rows": "SELECT o_orderstatus, count(*) AS rows FROM orders WHERE o_orderstatus <> 'O' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "index_status": """WITH m AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS cur, count(*) FILTER (o_orderstatus <> 'P') AS st FROM orders GROUP BY 1)
        SELECT count(*) AS catalog_rows, count(*) FILTER (cur) AS current_rows, coalesce(sum(st), 0)::BIGINT AS stale_rows, round(count(*) FILTER (cur)::DOUBLE / count(*), 6) AS coverage FROM customer LEFT JOIN m ON c_custkey = o_custkey""",
    "current_ids": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "fk_orphans": " UNION ALL ".join(f"SELECT '{c}.{a}' AS reference, count(*) AS orphans FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{b} = {c}.{a})" for c, a, p, b in _ORPHANS),
    "set_ops": """WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'),
        x AS (SELECT 'both' AS part, o_custkey FROM (FROM f INTERSECT FROM p) UNION ALL SELECT 'either', o_custkey FROM (FROM f UNION FROM p) UNION ALL SELECT 'left_only', o_custkey FROM (FROM f EXCEPT FROM p) UNION ALL SELECT 'right_only', o_custkey FROM (FROM p EXCEPT FROM f))
        SELECT part, count(*) AS keys, sum(o_custkey)::BIGINT AS key_sum FROM x GROUP BY part""",
    "graph_reach": """WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 6),
        r AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src WHERE hops < 25)
        SELECT src, dst, min(hops)::INT AS hops FROM r GROUP BY 1, 2""",
    "graph_cycles": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3) % 25 AS dst FROM nation),
        r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src FROM r WHERE src = dst""",
    "param_diff_full_outer": """WITH a AS (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 97 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 89 <> 0)
        SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.v AS base, b.v AS candidate, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.v IS DISTINCT FROM b.v OR a.p_partkey IS NULL OR b.p_partkey IS NULL""",
    "param_patch": "SELECT a.p_partkey, coalesce(b.p_size * 2, a.p_size) AS p_size FROM part a LEFT JOIN part b ON b.p_partkey % 10 = 0 AND b.p_partkey + 5 = a.p_partkey",
    "facet_filter_catalog": """SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE lower(c_mktsegment) IN ('building', 'machinery') AND c_acctbal BETWEEN 0 AND 5000 AND (lower(c_mktsegment) = 'building' OR lower(r_name) IN ('asia', 'europe')) AND lower(r_name) IN ('asia', 'europe', 'america')""",
    "text_normalise": r"""SELECT doc_id, sha256(regexp_replace(trim(text, ' '), '[\x09-\x0D\x20]+', ' ', 'g')) AS digest, regexp_replace(source || '/x y', '[^\p{L}\p{N}._-]', '_', 'g') AS token,
        length(left(nullif(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'), ' '), ''), 512))::INT AS kept FROM documents""",
    "text_identity_hash": "SELECT doc_id, sha256(trim(text, ' ')) AS identity, lower(lang) AS lang FROM documents",
    "content_duplicates": "SELECT sha256(text) AS digest, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) - 1 AS extra FROM documents GROUP BY text HAVING count(*) > 1",
    "page_url_parts": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^(.*)/', 1) AS folder FROM pages",
    "unlinked_nodes": """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) AND c_custkey NOT IN (SELECT o_custkey * 7 % 1000 + 1 FROM orders WHERE o_orderkey % 5 = 0)""",
    "dangling_choices": "SELECT l_partkey AS s_suppkey, count(*) AS lines FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "segment_plan": """WITH t AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS s FROM documents), c AS (SELECT *, CASE WHEN s >= 1 THEN least(ceil(s / 20), floor((s - 1) / 20) + 1) ELSE 0 END::INT AS n FROM t),
        p AS (SELECT doc_id, s, unnest(CASE WHEN n <= 16 THEN range(n) ELSE list_transform(range(16), lambda i: round_even(i * (n - 1)::DOUBLE / 15, 0)::BIGINT) END) AS i,
              unnest(range(least(n, 16))) AS segment FROM c)
        SELECT doc_id, segment::INT AS segment, round(i * 20.0::DOUBLE, 6) AS start_s, round(least(i * 20.0::DOUBLE + 30, s), 6) AS end_s, round(least(i * 20.0::DOUBLE + 30, s), 6) - i * 20.0::DOUBLE < 30 AS is_short FROM p""",
    "duration_policy": """SELECT doc_id, CASE WHEN s < 10 THEN 'INSUFFICIENT_AUDIO' WHEN s < 30 THEN 'SHORT_INPUT' ELSE 'NORMAL' END AS quality,
        CASE WHEN s < 60 THEN 1 WHEN s < 120 THEN 3 WHEN s < 210 THEN 5 WHEN s < 300 THEN 7 WHEN s < 420 THEN 9 ELSE 11 END AS windows FROM (SELECT doc_id, n_chars / 10.0::DOUBLE AS s FROM documents)""",
    "catalog_report": "SELECT coalesce(p_type, 'ALL') AS p_type, coalesce(p_brand, 'ALL') AS p_brand, count(*) AS parts, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY ROLLUP (p_type, p_brand)",
}
