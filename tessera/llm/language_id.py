"""Operator 4, language identification by nearest centroid.

A text becomes a unit vector of hashed letter n-grams (one to three letters, a
blank between words) weighted by TF-IDF. For each language several centroids
are fitted by spherical k-means, so that a language's registers needn't share
one mean; a text gets the language of the centroid with the greatest cosine,
and is marked as rejected where that cosine lies further below those of the
centroid's own texts than ``reject`` standard deviations.

Fitting uses at most about ``per_language`` labelled rows a language (a bounded
sample by a hash of the id), whose n-grams are counted and written once and dealt
to parts by a hash. In each of a few passes the parts' sums are added in Spark, in
the order of the parts, and only the result comes to the driver: the document
frequencies (``DIMENSIONS`` numbers) and the centroids. Prediction reads every
whole text once, without a shuffle.

Defined cases: a text that is null or has no letters is ``und`` with score 0;
without labelled rows every text is; rows that repeat an id are predicted by
their own texts; ties go to the first language in order; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, written

DIMENSIONS = 1 << 14
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray | None:
    """The hashed n-grams of a text, or None if it has no letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, 32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(codes) < 2:
        return None
    a, b, c = codes, codes[1:] * np.uint64(0x1F123BB5), codes[2:] * np.uint64(0x5BD1E995)
    grams = [a, a[:-1] + b + np.uint64(1 << 40), a[:-2] + b[:-1] + c + np.uint64(2 << 40)]
    h = np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 14)).astype(np.int64)


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    grams = ngrams(text)
    if grams is None:
        return None
    out = np.log1p(np.bincount(grams, minlength=DIMENSIONS)).astype(np.float32) * idf
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def labelled_sample(docs: DataFrame, learn: Column, per_language: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` labelled rows of each language, or all there are."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return rows.limit(0), []
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < rate * (1 << 20)
    return rows.filter(drawn), sorted(counts)


def counted(sample: DataFrame, parts: int) -> DataFrame:
    """``part, place, lang, slots, count``: the n-grams of a sample's texts, dealt to parts; texts without letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, slots, counts, upto = [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                if (grams := ngrams(text.as_py())) is not None:
                    own, n = np.unique(grams, return_counts=True)
                    rows.append(i), slots.append(own), counts.append(n), upto.append(upto[-1] + len(own))
            flat = [pa.array(np.concatenate(x or [np.empty(0)]).astype(np.int32)) for x in (slots, counts)]
            some = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(some.column(k) for k in ("part", "place", "lang")), *(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), x) for x in flat)], ["part", "place", "lang", "slots", "count"])

    place = F.xxhash64("doc_id", "text")
    dealt = sample.select(F.pmod(place, F.lit(parts)).cast("long").alias("part"), place.alias("place"), "lang", "text")
    return dealt.mapInArrow(run, "part long, place long, lang string, slots array<int>, count array<int>")


def fit(sample: DataFrame, languages: list[str], clusters: int, passes: int, reject: float, parts: int) -> dict:
    grams = written(counted(sample, parts), "grams")
    n = grams.count()
    found = grams.select(F.explode("slots").alias("i")).groupBy("i").agg(F.count("*").alias("n")).toPandas()
    df = np.zeros(DIMENSIONS)
    df[found["i"]] = found["n"]
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    number = {k: i for i, k in enumerate(languages)}
    dealt = grams.repartitionByRange(4 * parts, "part").persist()  # ranges finer than the parts: one part a task

    def sums_of(centroids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of vectors by centroid, and the number and sums of the cosines; without centroids, by a hash of the text."""

        def assign(rows: pa.Table) -> pa.Table:
            sums, stats = {}, {}
            rows = rows.sort_by([("place", "ascending"), ("lang", "ascending")])
            for place, lang, slots, count in zip(*(rows[k] for k in ("place", "lang", "slots", "count"))):
                at = slots.values.to_numpy()
                v = np.log1p(count.values.to_numpy()) * idf[at]
                v /= np.linalg.norm(v) or 1.0
                best, cosine = number[lang.as_py()] * clusters, 0.0
                if centroids is None:
                    best += (place.as_py() >> 8) % clusters
                else:
                    cosines = centroids[best : best + clusters, at] @ v
                    best, cosine = best + int(cosines.argmax()), float(cosines.max())
                sums.setdefault(best, np.zeros(DIMENSIONS))[at] += v
                stats[best] = stats.get(best, 0) + np.array([1, cosine, cosine * cosine])
            some = sorted(sums)
            return pa.table({"part": pa.array([rows["part"][0].as_py()] * len(some), pa.int64()), "c": pa.array(some, pa.int64()), "v": pa.array([sums[c].tobytes() for c in some], pa.binary()), "s": pa.array([stats[c].tobytes() for c in some], pa.binary())})

        def add(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("part")
            totals = [sum(np.frombuffer(x.as_py()) for x in rows[k]).tobytes() for k in ("v", "s")]
            return pa.table({"c": pa.array([rows["c"][0].as_py()], pa.int64()), "v": pa.array(totals[:1], pa.binary()), "s": pa.array(totals[1:], pa.binary())})

        each = dealt.groupBy("part").applyInArrow(assign, "part long, c long, v binary, s binary")
        sums, stats = np.zeros((len(languages) * clusters, DIMENSIONS)), np.zeros((len(languages) * clusters, 3))
        for r in each.groupBy("c").applyInArrow(add, "c long, v binary, s binary").collect():  # a row for each centroid
            sums[r["c"]], stats[r["c"]] = np.frombuffer(r["v"]), np.frombuffer(r["s"])
        return sums, stats

    centroids = None
    for _ in range(passes + 1):
        sums, stats = sums_of(centroids)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)
        centroids = fresh if centroids is None else np.where(norms > 0, fresh, centroids)  # an empty cluster keeps its place
    dealt.unpersist()
    count = np.maximum(stats[:, 0], 1)
    mean = stats[:, 1] / count
    floor = mean - reject * np.sqrt(np.maximum(stats[:, 2] / count - mean**2, 0))
    return {"idf": idf, "centroids": centroids, "floor": floor, "languages": languages, "clusters": clusters}


def identify(docs: DataFrame, learn: Column, *, clusters: int = 3, per_language: int = 1500, passes: int = 4, reject: float = 4.0, parts: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row of ``docs``; rows
    where ``learn`` holds and the language isn't null may be learned from."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("_learn"))
    sample, languages = labelled_sample(named, F.col("_learn"), per_language)
    model = fit(sample, languages, clusters, passes, reject, parts) if languages else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column("text"):
                v = vector(text.as_py(), m["idf"]) if m else None
                if v is None:
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                cosines = m["centroids"] @ v
                best = int(cosines.argmax())
                langs.append(m["languages"][best // m["clusters"]])
                scores.append(float(np.clip(cosines[best], 0, 1)))
                rejected.append(bool(cosines[best] < m["floor"][best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return named.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
