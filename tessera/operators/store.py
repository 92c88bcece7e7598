"""A store of embeddings as tables: what is put, moved, deleted, counted and logged.

A store is a table ``key, backend, scope, track_id, start_s, end_s, path,
dimension, vector, digest, seq``; ``seq`` grows with each write. Every change
gives the table after it, to be written to a new folder or merged into a table
format that can; rows of other keys aren't touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.latest import latest

SCOPES = ("full", "segment", "representative", "text")  # Fixed values


def digest(vector: str | Column = "vector") -> Column:
    """SHA-256 of the members' shortest decimal forms, in order."""
    x = F.col(vector) if isinstance(vector, str) else vector
    return F.sha2(F.array_join(F.transform(x, lambda v: v.cast("float").cast("string")), ","), 256)


def identity_key(backend: Column, scope: Column, track: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the JSON object of what an embedding is of; times in milliseconds."""
    ms = lambda t: F.round(t * 1000).cast("long")
    fields = F.struct(backend.alias("backend"), ms(end).alias("end_ms"), scope.alias("scope"), ms(start).alias("start_ms"), track.alias("track"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def register(models: DataFrame, new: DataFrame) -> DataFrame:
    """Backends by fingerprint, the last registration of each."""
    return latest(models.unionByName(new), ["fingerprint"], ["seq"]).drop("rn")


def guarded(new: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``refused``: why a row can't be put, or null."""
    known = models.select(F.col("fingerprint").alias("backend"), F.col("dimension").alias("_dimension"))
    out = new.join(known, "backend", "left")
    why = F.when(F.col("_dimension").isNull(), "unknown backend").when(F.size("vector") != F.col("_dimension"), "other dimension").when(~F.col("scope").isin(*SCOPES), "unknown scope")
    return out.withColumn("refused", why.when((F.col("scope") != "text") & F.coalesce(F.col("path") == "", F.lit(True)), "no path")).drop("_dimension")


def put(store: DataFrame, new: DataFrame, models: DataFrame) -> DataFrame:
    """The store with the rows that may be put; a key that is there gets the new
    path, vector and digest."""
    fresh = guarded(new, models).filter("refused is null").drop("refused").withColumns({"dimension": F.size("vector"), "digest": digest()})
    return latest(store.unionByName(fresh), ["key"], ["seq"]).drop("rn")


def intact(store: DataFrame, tolerance: float = 1e-5) -> Column:
    """Whether a row's vector is the one that was written, whole and of length 1."""
    finite = F.forall("vector", lambda e: ~F.isnan(e) & (F.abs(e) < float("inf")))
    length = F.abs(F.sqrt(search.dot("vector", "vector")) - 1) <= tolerance
    return F.coalesce((F.col("digest") == digest()) & (F.size("vector") == F.col("dimension")) & finite & length, F.lit(False))


def get(store: DataFrame, key: str, backend: str, scope: str) -> DataFrame:
    """The row of a key, with ``state``: ok, corrupt, or mismatch where it is of another identity."""
    same = (F.col("backend") == backend) & (F.col("scope") == scope)
    return store.filter(F.col("key") == key).withColumn("state", F.when(~same, "mismatch").when(~intact(store), "corrupt").otherwise("ok"))


def moved(store: DataFrame, paths: DataFrame) -> DataFrame:
    """The store with new paths (``key, new_path``); texts have none."""
    new = F.when(F.col("scope") != "text", F.col("new_path"))
    return store.join(paths.select("key", "new_path"), "key", "left").withColumn("path", F.coalesce(new, F.col("path"))).drop("new_path")


def without_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key").distinct(), "key", "left_anti")


def without_scope(store: DataFrame, backend: str, scope: str = "full") -> DataFrame:
    return store.filter(~((F.col("backend") == backend) & (F.col("scope") == scope)))


def without_corrupt(store: DataFrame) -> DataFrame:
    return store.filter(intact(store))


def counts(store: DataFrame, backend: str | None = None) -> DataFrame:
    """``scope, rows`` and the ``total``."""
    own = store if backend is None else store.filter(F.col("backend") == backend)
    return own.rollup("scope").agg(F.count("*").alias("rows")).select(F.coalesce("scope", F.lit("total")).alias("scope"), "rows")


def canonical_filters(filters: str | Column) -> Column:
    """A map of filters as JSON with its keys in order."""
    x = F.col(filters) if isinstance(filters, str) else filters
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))


def logged(log: DataFrame, searches: DataFrame) -> DataFrame:
    """The log of searches with those that are valid: text searches have a text,
    audio searches a track, and all a positive number of results asked for."""
    valid = ((F.col("query_type") == "text") & (F.coalesce("query_text", F.lit("")) != "")) | ((F.col("query_type") == "audio") & (F.coalesce("query_track", F.lit("")) != ""))
    rows = searches.filter(valid & (F.col("top_k") > 0)).withColumn("filters", canonical_filters("filters"))
    return log.unionByName(rows)


def replaced_representatives(store: DataFrame, chosen: DataFrame) -> DataFrame:
    """The store where a track's representative of a backend is only the chosen
    one (``backend, track_id, key``); tracks without a choice keep theirs."""
    pick = chosen.select("backend", "track_id", F.col("key").alias("_key"))
    held = store.join(pick, ["backend", "track_id"], "left")
    return held.filter((F.col("scope") != "representative") | F.col("_key").isNull() | (F.col("key") == F.col("_key"))).drop("_key")


def segment_status(store: DataFrame, catalog: DataFrame, chosen: DataFrame, backend: str, policy: str) -> DataFrame:
    """One row: catalog tracks, rows of the backend by scope, tracks with a
    representative of the policy, and rows of other backends."""
    own = F.col("backend") == backend
    scope = lambda s: F.col("scope") == s
    stale = lambda s: F.count_if(~own & scope(s) & F.col("track_id").isNotNull())
    sums = store.agg(F.count_if(own & scope("segment")).alias("segments"), F.count_if(own & scope("representative")).alias("representatives"), stale("segment").alias("stale_segments"), stale("representative").alias("stale_representatives"))
    represented = chosen.filter(own & (F.col("policy") == policy)).agg(F.count_distinct("track_id").alias("represented"))
    return catalog.agg(F.count_distinct("track_id").alias("tracks")).join(represented).join(sums)  # one row each


def interval_search(store: DataFrame, backend: str, query: Sequence[float], start_s: float, end_s: float, *, track: object = None, target: str = "full", k: int = 20, where: Column | None = None) -> DataFrame:
    """``track_id, similarity, rank``: the best tracks of a scope for the vector of a time interval.
    Other rows of the query's own track are left out; an interval has at least a second."""
    if not 0 <= start_s < end_s or end_s - start_s < 1:
        raise ValueError("an interval has 0 <= start, and at least a second to its end")
    if k <= 0:
        raise ValueError("k must be positive")
    rows = store.filter((F.col("backend") == backend) & (F.col("scope") == target) & F.col("track_id").isNotNull())
    return search.top_k(rows, query, k=k, id_col="track_id", vector_col="vector", where=where, exclude=track)


def enriched(hits: DataFrame, catalog: DataFrame, key: str = "track_id") -> DataFrame:
    """Hits with what the catalog says of their tracks; tracks it lacks stay."""
    return hits.join(catalog, key, "left")


def weighted_centroid(chunks: DataFrame, by: Sequence[str], vector: str = "vector", weight: str = "weight") -> DataFrame:
    """``by, vector``: the mean of vectors by weight, at length 1. Positions are
    averaged with partial aggregation, so a large group is no single task's."""
    places = chunks.filter(F.col(weight) > 0).select(*by, weight, F.posexplode(vector).alias("_i", "_x"))
    means = places.groupBy(*by, "_i").agg((F.sum(F.col("_x").cast("double") * F.col(weight)) / F.sum(weight)).alias("_m"))
    whole = means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_v"))
    return whole.select(*by, search.unit("_v").alias(vector))


def chunk_starts(n: Column, size: int) -> Column:
    """The starts of chunks of ``size`` over ``n`` tokens; the last is moved back so that it is whole."""
    whole = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(size))
    return F.when(n <= size, F.array(F.lit(0))).when(n % size == 0, whole).otherwise(F.concat(whole, F.array((n - size).cast("int"))))


def rebuilt(store: DataFrame, backend: str, new: DataFrame, scope: str = "full") -> DataFrame:
    """The store with one backend's rows of a scope made anew; those of others stay."""
    return without_scope(store, backend, scope).unionByName(new, allowMissingColumns=True)


def chosen_segments(store: DataFrame, backend: str, policy: str) -> DataFrame:
    """``backend, track_id, policy, key, score``: of each track the segment nearest to the centroid of its segments."""
    own = store.filter((F.col("backend") == backend) & (F.col("scope") == "segment") & F.col("track_id").isNotNull())
    best = search.representatives(own.select("track_id", "key", "start_s", "vector").withColumn("order", F.row_number().over(Window.partitionBy("track_id").orderBy("start_s", "key"))), "track_id", id_col="order", vector_col="vector")
    keys = own.select("track_id", "key", F.row_number().over(Window.partitionBy("track_id").orderBy("start_s", "key")).alias("order"))
    return best.join(keys, ["track_id", "order"]).select(F.lit(backend).alias("backend"), "track_id", F.lit(policy).alias("policy"), "key", "score")


def acceptance(catalog: DataFrame, store: DataFrame, backend: str, readable: Column, least: float = 0.99) -> DataFrame:
    """One row: catalog tracks, readable ones, those with a full row of the backend, their share and whether it is enough."""
    held = store.filter((F.col("backend") == backend) & (F.col("scope") == "full")).select(F.col("track_id").alias("_held")).distinct()
    rows = catalog.select("track_id", readable.alias("_readable")).join(held, F.col("track_id") == F.col("_held"), "left")
    out = rows.agg(F.count("*").alias("tracks"), F.count_if("_readable").alias("readable"), F.count_if(F.col("_readable") & F.col("_held").isNotNull()).alias("embedded"))
    share = F.when(F.col("readable") > 0, F.col("embedded") / F.col("readable")).otherwise(0.0)
    return out.select("*", share.alias("coverage"), (share >= least).alias("accepted"))


def to_retry(catalog: DataFrame, store: DataFrame, backend: str, readable: Column) -> DataFrame:
    """The readable tracks that lack a whole full row of the backend; corrupt rows don't count."""
    held = store.filter((F.col("backend") == backend) & (F.col("scope") == "full")).filter(intact(store)).select("track_id")
    return catalog.filter(readable).join(held, "track_id", "left_anti")
