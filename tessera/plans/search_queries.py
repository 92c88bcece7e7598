"""Queries of exact vector search and retrieval quality on ``embeddings``.

Query vectors are a fixed set of rows (the search's own input); every search is
against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources.tables import load

SQL_DOT = "list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"


def _vector(catalog: DataFrame, vec_id: int) -> list[float]:
    found = catalog.filter(F.col("vec_id") == vec_id).select("embedding").first()
    if found is None:
        raise ValueError(f"no vector {vec_id}")
    return found[0]


def search_topk_filtered(spark, d):
    catalog = load(spark, d, "embeddings")
    found = search.top_k(catalog, _vector(catalog, 0), k=20, where=F.col("label").isin(1, 3, 5, 7), exclude=0)
    return found.select("rank", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


SEARCH_TOPK_FILTERED = f"""
SELECT row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank, vec_id, label, round(s, 6) AS similarity
FROM (SELECT a.vec_id, a.label, {SQL_DOT} AS s FROM embeddings a, embeddings b
      WHERE b.vec_id = 0 AND a.vec_id <> 0 AND a.label IN (1, 3, 5, 7) ORDER BY s DESC, vec_id LIMIT 20)
"""


def search_topk_enriched(spark, d):
    catalog, part = load(spark, d, "embeddings"), load(spark, d, "part")
    found = search.top_k(catalog, _vector(catalog, 7), k=20, exclude=7)
    hits = found.join(part, found["vec_id"] == part["p_partkey"], "left")
    return hits.select("rank", "vec_id", F.round("similarity", 6).alias("similarity"), F.coalesce("p_brand", F.lit("UNKNOWN")).alias("brand"), F.coalesce("p_type", F.lit("UNKNOWN")).alias("kind"))


SEARCH_TOPK_ENRICHED = f"""
SELECT rank, vec_id, round(s, 6) AS similarity, coalesce(p_brand, 'UNKNOWN') AS brand, coalesce(p_type, 'UNKNOWN') AS kind
FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM (
      SELECT a.vec_id, {SQL_DOT} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 7 AND a.vec_id <> 7)) h
LEFT JOIN part ON p_partkey = vec_id WHERE rank <= 20
"""


def _batch(spark, d, k=10):
    catalog = load(spark, d, "embeddings")
    queries = catalog.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return catalog, queries, search.top_k_batch(catalog, queries, k=k)


def search_batch_queries(spark, d):
    return _batch(spark, d)[2].select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


SQL_BATCH = f"""
  SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank, label, query_label
  FROM (SELECT b.vec_id AS query_id, b.label AS query_label, a.vec_id, a.label, {SQL_DOT} AS s
        FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
"""
SEARCH_BATCH = f"SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM ({SQL_BATCH}) WHERE rank <= 10"


def _metrics(spark, d):
    catalog, queries, ranked = _batch(spark, d)
    # A row is relevant to queries of its label, with a grade by its number; the numbers of each follow from counts by label.
    grade = (1 + F.col("vec_id") % 3).cast("int").alias("grade")
    asked = catalog.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), grade.alias("own_grade"))
    graded = ranked.join(asked, "query_id").join(catalog.select("vec_id", "label"), "vec_id").filter("label = query_label").select("query_id", "rank", grade)
    sizes = catalog.groupBy("label", grade).agg(F.count("*").alias("n"))
    counts = asked.join(sizes, F.col("label") == F.col("query_label")).select("query_id", "grade", (F.col("n") - (F.col("grade") == F.col("own_grade")).cast("int")).alias("n"))
    return search.graded_metrics(graded, counts.filter("n > 0"), k=10)


def ir_metrics_per_query(spark, d):
    m = _metrics(spark, d)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


def ir_metrics_macro(spark, d):
    m = search.macro(_metrics(spark, d))
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns if c != "queries"])


SQL_METRICS = f"""
WITH ranked AS ({SQL_BATCH}), g AS (
  SELECT *, CASE WHEN label = query_label THEN 1 + vec_id % 3 ELSE 0 END AS grade FROM ranked
), i AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, vec_id) AS irank FROM g
), m AS (
  SELECT query_id,
         count(*) FILTER (rank <= 10 AND grade > 0) / 10.0::DOUBLE AS precision_at_k,
         CASE WHEN count(*) FILTER (grade > 0) > 0 THEN count(*) FILTER (rank <= 10 AND grade > 0)::DOUBLE / count(*) FILTER (grade > 0) ELSE 0 END AS recall_at_k,
         coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10 AND grade > 0), 0) AS reciprocal_rank,
         CASE WHEN count(*) FILTER (grade > 0) > 0 THEN
           coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10 AND grade > 0), 0)
           / sum((pow(2, grade) - 1) / log2(irank + 1)) FILTER (irank <= 10 AND grade > 0) ELSE 0 END AS ndcg_at_k
  FROM i GROUP BY query_id HAVING count(*) FILTER (grade > 0) > 0
)
"""
IR_PER_QUERY = SQL_METRICS + "SELECT query_id, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_k, 6) AS ndcg_at_k FROM m"
IR_MACRO = SQL_METRICS + "SELECT count(*) AS queries, round(avg(precision_at_k), 6) AS mean_precision_at_k, round(avg(recall_at_k), 6) AS mean_recall_at_k, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, round(avg(ndcg_at_k), 6) AS mean_ndcg_at_k FROM m"


def paired_query_jaccard(spark, d):
    """Overlap of the results of query pairs (each query with the next one)."""
    ranked = _batch(spark, d)[2].groupBy("query_id").agg(F.collect_set("vec_id").alias("found"))
    other = ranked.select((F.col("query_id") - 20).alias("query_id"), F.col("query_id").alias("paired_id"), F.col("found").alias("paired"))
    return ranked.join(other, "query_id").select("query_id", "paired_id", F.round(search.jaccard(F.col("found"), F.col("paired")), 6).alias("jaccard"))


PAIRED_JACCARD = f"""
WITH r AS (SELECT query_id, list(vec_id) AS found FROM ({SQL_BATCH}) WHERE rank <= 10 GROUP BY query_id)
SELECT a.query_id, b.query_id AS paired_id,
       round(len(list_intersect(a.found, b.found))::DOUBLE / len(list_distinct(a.found || b.found)), 6) AS jaccard
FROM r a JOIN r b ON b.query_id = a.query_id + 20
"""


def representative_per_group(spark, d):
    found = search.representatives(load(spark, d, "embeddings"), "label")
    return found.select("label", "vec_id", F.round("score", 6).alias("score"))


REPRESENTATIVE = """
WITH e AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c),
s AS (SELECT label, vec_id, sum(x * m) AS s FROM e JOIN n USING (label, i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rn FROM s)
SELECT label, vec_id, round(s, 6) AS score FROM r WHERE rn = 1
"""


def attack_pair_similarity(spark, d):
    """Statistics of the similarities of all pairs in a group, without the pairs:
    sums of dot products follow from the sum vector."""
    e = load(spark, d, "embeddings")
    size = e.groupBy("label").agg(F.count("*").alias("n"), F.sum(search.dot("embedding", "embedding")).alias("own"))
    sums = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return size.join(sums, "label").filter("n > 1").select("label", pairs.alias("pairs"), F.round((F.col("all") - F.col("own")) / 2 / pairs, 6).alias("mean_similarity"))


ATTACK_PAIRS = f"SELECT a.label, count(*) AS pairs, round(avg({SQL_DOT}), 6) AS mean_similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label"


def vector_audit(spark, d):
    """Which vectors are whole: dimension, finite members, unit length."""
    e = load(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(search.valid_vector("embedding", 64)).alias("valid"), F.count_if(F.size("embedding") != 64).alias("wrong_dimension"))


VECTOR_AUDIT = """
SELECT label, count(*) AS vectors,
       count(*) FILTER (len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-5) AS valid,
       count(*) FILTER (len(embedding) <> 64) AS wrong_dimension
FROM embeddings GROUP BY label
"""

QUERIES = {
    "search_topk_filtered": search_topk_filtered,
    "search_topk_enriched": search_topk_enriched,
    "search_batch_queries": search_batch_queries,
    "ir_metrics_per_query": ir_metrics_per_query,
    "ir_metrics_macro": ir_metrics_macro,
    "paired_query_jaccard": paired_query_jaccard,
    "representative_per_group": representative_per_group,
    "attack_pair_similarity": attack_pair_similarity,
    "vector_audit": vector_audit,
}
SQL = {
    "search_topk_filtered": SEARCH_TOPK_FILTERED,
    "search_topk_enriched": SEARCH_TOPK_ENRICHED,
    "search_batch_queries": SEARCH_BATCH,
    "ir_metrics_per_query": IR_PER_QUERY,
    "ir_metrics_macro": IR_MACRO,
    "paired_query_jaccard": PAIRED_JACCARD,
    "representative_per_group": REPRESENTATIVE,
    "attack_pair_similarity": ATTACK_PAIRS,
    "vector_audit": VECTOR_AUDIT,
}
