"""Exact vector search and its measures.

Queries are few and the catalog is large: query vectors are sent to the
catalog's tasks when their count is below ``BROADCAST_QUERIES`` and otherwise
taken in blocks of that many, so the catalog is scanned in place and never
shuffled. Each task keeps its best rows before anything moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_QUERIES = 4096
SCORES = 1_000_000  # held by a task at once


def dot(a: str | Column, b: str | Column) -> Column:
    """Of two arrays, in double."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: str | Column) -> Column:
    """The vector at length 1; null if it has none."""
    x = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda e: e.cast("double") / norm))


def valid_vector(v: str | Column, dimension: int) -> Column:
    """Whether a vector has its dimension, finite members and length 1 within 1e-5."""
    x = F.col(v) if isinstance(v, str) else v
    finite = F.forall(x, lambda e: ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return (F.size(x) == dimension) & finite & (F.abs(F.sqrt(dot(x, x)) - 1) <= 1e-5)


def top_k(catalog: DataFrame, query: Sequence[float], *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None, exclude=None) -> DataFrame:
    """``id, similarity, rank``: the best rows for one query vector by similarity,
    then id. Filters and the exclusion of the query's own row apply before scoring,
    so ranks are dense over what is left."""
    rows = catalog if where is None else catalog.filter(where)
    if exclude is not None:
        rows = rows.filter(F.col(id_col) != exclude)
    literal = F.array(*[F.lit(float(x)) for x in query])
    best = rows.withColumn("similarity", dot(vector_col, literal)).orderBy(F.col("similarity").desc(), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), id_col)))  # over k rows


def best_of(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` best rows ``id, vector`` of a task for each of its queries, as arrays of query, row and score: at most ``SCORES`` scores
    are there at once, and only those that reach a query's worst so far are looked at."""
    keys, values, edge = [np.empty(0, np.int64)] * len(ids), [np.empty(0)] * len(ids), np.full(len(ids), -np.inf)
    step = max(1, SCORES // max(1, len(ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            own = rows.column(0).to_numpy()
            scores = q @ rows.column(1).flatten().to_numpy().reshape(len(own), -1).astype(np.float64).T
            np.round(scores, 12, out=scores)  # sums depend on the batch in the last digits
            near = scores >= edge[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                there = np.flatnonzero(near[i])
                if exclude_self:
                    there = there[own[there] != ids[i]]
                found, score = np.concatenate([keys[i], own[there]]), np.concatenate([values[i], scores[i, there]])
                if len(found) > k:
                    worst = np.partition(score, len(score) - k)[len(score) - k]
                    there = np.flatnonzero(score >= worst)  # with all ties at the edge
                    by = there[np.lexsort((found[there], -score[there]))][:k]
                    found, score = found[by], score[by]
                keys[i], values[i] = found, score
                edge[i] = score.min() if len(score) >= k else -np.inf
    for i in range(0, len(ids), 256):
        some = range(i, min(i + 256, len(ids)))
        yield np.repeat(ids[i : i + 256], [len(keys[j]) for j in some]), np.concatenate([keys[j] for j in some]), np.concatenate([values[j] for j in some])


def top_k_batch(catalog: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", exclude_self: bool = True) -> DataFrame:
    """``query_id, id, similarity, rank`` for many query vectors, all against the
    whole catalog, in blocks: each task multiplies its rows with a block of
    queries and passes on its ``k`` best of each, and a window ranks those."""
    count = queries.count()
    out = None
    blocks = max(1, math.ceil(count / BROADCAST_QUERIES))
    spark = catalog.sparkSession
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)
        rows = part.select(query_id, vector_col).toPandas()  # a block of bounded size
        if rows.empty:
            continue
        shared = spark.sparkContext.broadcast((rows[query_id].to_numpy(), np.stack(rows[vector_col].to_numpy()).astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for own, part, values in best_of(batches, ids, q, k, exclude_self):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(part), pa.array(values)], [query_id, id_col, "similarity"])

        found = catalog.select(id_col, vector_col).mapInArrow(run, f"{query_id} long, {id_col} long, similarity double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], f"{query_id} long, {id_col} long, similarity double")
    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def graded_metrics(graded: DataFrame, counts: DataFrame, *, k: int, query_id: str = "query_id") -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at ``k`` for each query of
    ``counts`` (``query_id, grade, n``: how many rows have each grade above 0; a query
    without any has a row of grade 0). ``graded`` has the ranked rows with their
    ``grade``. The ideal order follows from the counts, so relevant rows that weren't
    found are never listed. Precision divides by ``k``, whatever was returned; without
    a relevant row recall and nDCG are 0."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    hits = graded.filter((F.col("rank") <= k) & (F.col("grade") > 0))
    got = hits.groupBy(query_id).agg(F.count("*").alias("_hits"), F.min("rank").alias("_first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("_dcg"))
    better = F.coalesce(F.sum("n").over(Window.partitionBy(query_id).orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.filter("grade > 0").withColumn("_before", better).withColumn("_upto", F.least(F.col("_before") + F.col("n"), F.lit(k)))
    own = F.when(F.col("_upto") > F.col("_before"), F.aggregate(F.sequence(F.col("_before") + 1, F.col("_upto")), F.lit(0.0), lambda a, i: a + gain(F.col("grade"), i)))
    ideal = places.groupBy(query_id).agg(F.sum("n").alias("_relevant"), F.sum(own).alias("_ideal"))
    all_ = counts.select(query_id).distinct().join(ideal, query_id, "left").join(got, query_id, "left").fillna(0, ["_hits", "_relevant"]).fillna(0.0, ["_dcg", "_ideal"])
    return all_.select(
        query_id,
        (F.col("_hits") / F.lit(float(k))).alias("precision_at_k"),
        F.when(F.col("_relevant") > 0, F.col("_hits") / F.col("_relevant")).otherwise(0.0).alias("recall_at_k"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg_at_k"),
    )


def ranking_metrics(ranked: DataFrame, grades: DataFrame, *, k: int, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """The same from judgements (``query_id, id, grade``)."""
    graded = ranked.filter(F.col("rank") <= k).join(grades, [query_id, id_col])
    return graded_metrics(graded, grades.groupBy(query_id, "grade").agg(F.count("*").alias("n")), k=k, query_id=query_id)


def macro(metrics: DataFrame) -> DataFrame:
    names = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(c).alias(f"mean_{c}") for c in names])


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def representatives(rows: DataFrame, group: str, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``group, id, score``: of each group the row nearest to the unit vector of its
    centroid; ties go to the least id. Positions are averaged with partial
    aggregation, so a large group is no single task's."""
    places = rows.select(group, F.posexplode(vector_col).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroid = places.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).select(group, unit(F.col("c")).alias("c"))
    scored = rows.join(centroid, group).withColumn("score", dot(vector_col, "c"))
    return scored.groupBy(group).agg(F.max_by(F.struct(id_col, "score"), F.struct("score", (-F.col(id_col)).alias("o"))).alias("b")).select(group, f"b.{id_col}", "b.score")
