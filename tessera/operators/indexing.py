"""An index of embeddings kept up to date: only what is missing is embedded.

A backend turns payloads into vectors; it is made once in each task. Rows are
keyed by a hash of backend and item, so a second run embeds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import rhythm, signal
from tessera.operators.search import unit, valid_vector

ROWS = "item string, vector array<float>"


class Backend(Protocol):
    name: str
    dimension: int

    def embed(self, payloads: list[str]) -> np.ndarray: ...


class HashBackend:
    """A deterministic stand-in for a model: the same payload, the same unit vector."""

    def __init__(self, dimension: int = 16, name: str = "hash") -> None:
        self.name, self.dimension = f"{name}-{dimension}", dimension

    def embed(self, payloads: list[str]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(p.encode()).digest()[:8], "little") for p in payloads]
        x = np.stack([np.random.default_rng(s).normal(size=self.dimension) for s in seeds]) if seeds else np.zeros((0, self.dimension))
        return x / np.linalg.norm(x, axis=1, keepdims=True)


class FrameBackend(Protocol):
    """What turns framed audio into vectors, a Spark job for all files together."""

    name: str
    dimension: int

    def embed_frames(self, framed: DataFrame) -> DataFrame: ...


class AcousticBackend:
    """The acoustic vectors of a file's frames; files without power have none."""

    def __init__(self, bands: int = 512) -> None:
        self.name, self.dimension, self.bands = f"acoustic-78-{bands}", 78, bands

    def embed_frames(self, framed: DataFrame) -> DataFrame:
        found = rhythm.acoustic_vectors(signal.spectra(framed, self.bands))
        return found.select(F.col("path").alias("item"), F.transform("vector", lambda x: x.cast("float")).alias("vector"))


def cache_key(backend: str, item: str | Column = "item") -> Column:
    """SHA-256 of the JSON of backend and item."""
    item = F.col(item) if isinstance(item, str) else item
    return F.sha2(F.to_json(F.struct(F.lit(backend).alias("backend"), item.alias("item"))), 256)


def embed(rows: DataFrame, make: Callable[[], Backend], item: str = "item", payload: str = "payload") -> DataFrame:
    """``item, vector``; null payloads have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for part in parts:
            vectors = backend.embed(part[payload].tolist())
            yield pd.DataFrame({"item": part[item].astype(str), "vector": list(vectors.astype(np.float32))})

    return rows.filter(F.col(payload).isNotNull()).select(item, payload).mapInPandas(run, ROWS)


def work(catalog: DataFrame, index: DataFrame, backend: str) -> DataFrame:
    """The catalog rows that have no whole row of this backend in the index."""
    return catalog.withColumn("key", cache_key(backend)).join(index.filter(F.col("backend") == backend).select("key").distinct(), "key", "left_anti")


def updated(catalog: DataFrame, index: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """New index rows ``key, backend, item, vector`` to append."""
    backend = make()
    found = embed(work(catalog, index, backend.name), make)
    whole = found.withColumn("vector", F.transform(unit("vector"), lambda x: x.cast("float")))
    whole = whole.filter(valid_vector("vector", backend.dimension))
    return whole.select(cache_key(backend.name).alias("key"), F.lit(backend.name).alias("backend"), "item", "vector")


def updated_frames(catalog: DataFrame, framed: DataFrame, index: DataFrame, backend: FrameBackend) -> DataFrame:
    """New index rows of the catalog's items, from their frames (``path`` is the item): frames of items that the index has aren't looked at."""
    missing = work(catalog, index, backend.name).select(F.col("item").alias("path")).distinct()
    found = backend.embed_frames(framed.join(missing, "path", "left_semi"))
    whole = found.withColumn("vector", F.transform(unit("vector"), lambda x: x.cast("float"))).filter(valid_vector("vector", backend.dimension))
    return whole.select(cache_key(backend.name).alias("key"), F.lit(backend.name).alias("backend"), "item", "vector")


def interval_query(framed: DataFrame, size: int, item: str, start_s: float, end_s: float, backend: FrameBackend) -> list[float] | None:
    """The vector of a time interval of a file, from its frames cut to it; None where they have no power. Frames have ``size`` samples."""
    if not 0 <= start_s < end_s or end_s - start_s < 1:
        raise ValueError("an interval has 0 <= start, and at least a second to its end")
    cut = rhythm.interval(framed.filter(F.col("path") == item), size, start_s, end_s)
    row = backend.embed_frames(cut).first()
    return None if row is None else list(row["vector"])


def window_tags(logits: DataFrame, by: str = "item", most: int = 10) -> DataFrame:
    """``by, rank, label, score``: the labels of the greatest mean probability over an item's windows (``by, label, logit``), the later
    label first among equals. Means are combined by task before they are shuffled."""
    means = logits.groupBy(by, "label").agg(F.avg(1 / (1 + F.exp(-F.col("logit")))).alias("score"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("label").desc())
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, most)).select(by, "rank", "label", F.round("score", 6).alias("score"))


def run_report(catalog: DataFrame, index: DataFrame, backend: str) -> DataFrame:
    """One row: catalog rows, hits, misses, rows of other backends."""
    marks = index.groupBy("item").agg(F.bool_or(F.col("backend") == backend).alias("_own"), F.count_if(F.col("backend") != backend).alias("_other"))
    rows = catalog.select("item").distinct().join(marks, "item", "left")
    return rows.agg(F.count("*").alias("catalog_rows"), F.count_if("_own").alias("hits"), F.count_if(~F.coalesce("_own", F.lit(False))).alias("misses"), F.coalesce(F.sum("_other"), F.lit(0)).alias("stale_rows"))
