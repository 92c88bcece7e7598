"""Operator 5, quality classifier: a factorisation machine.

A text becomes a sparse vector of its hashed words (by the root of their
share), dense statistics of its structure (lengths, cases, punctuation,
repetition) and its character count as metadata. The machine scores

    w0 + sum(w_i x_i) + sum over pairs of <v_i, v_j> x_i x_j

in time linear in the features, as the sum over pairs is half of the
difference between the square of the sums and the sum of the squares.

It is fitted on at most about ``sample_rows`` labelled rows (a bounded sample by
a hash of the id), whose features are computed and written once. The sample is
dealt to parts by a hash, whatever the number of cores or files: in each round
every part trains from the common weights with AdaGrad in a fixed order, one task
a part, and the weights are averaged in the order of the parts, so that reruns
agree. Only weights, whose size is fixed, pass through the driver. Scoring reads
every whole text once, without a shuffle.

Defined cases: a null or empty text is scored by its (empty) features; without
labelled rows every score is 0.5; labels other than 0 and 1 and null labels are
left out; of several labels of one id the majority counts, 0 in a tie; rows that
repeat an id are scored by their own texts; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, written

HASHED = 1 << 15
RANK = 8
CACHED_WORDS = 300_000
N_STATS = 17
SIZE = HASHED + N_STATS


class Slots(dict):
    """The slot of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) % HASHED
        return value


def features(text: str | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features that aren't zero."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n, chars = len(words), max(1, len(raw))
    code = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(code, minlength=256)
    lines = [x.strip() for x in raw.split(b"\n")]
    own = np.fromiter(map(slots.__getitem__, words), np.int64, n)
    index, count = np.unique(own, return_counts=True)
    same = float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
    stats = np.array(
        [
            np.log1p(n) / 8,
            np.log1p(chars) / 10,  # the metadata: characters, as bytes
            min(2.0, chars / max(1, n) / 8),
            kinds[65:91].sum() / chars,
            kinds[48:58].sum() / chars,
            min(1.0, 10 * kinds[33] / max(1, n)),
            min(1.0, 10 * kinds[[35, 36, 37, 38, 42, 60, 62, 124, 123, 125]].sum() / chars),
            min(1.0, 5 * kinds[[44, 46, 59, 58, 63]].sum() / max(1, n)),
            len(index) / max(1, n) ** 0.85,
            same,
            float(count.max()) / n if n else 0.0,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(lines)) / 5,
            np.log1p(n / len(lines)) / 5,
            float(kinds[128:].sum()) / chars,
            1.0 if n < 20 else 0.0,
            min(1.0, 10 * (kinds[64] + kinds[47]) / max(1, n)),
        ],
        np.float32,
    )
    values = np.sqrt(count / max(1, n)).astype(np.float32)
    return np.concatenate([index, HASHED + np.arange(N_STATS)]), np.concatenate([values, stats])


def margin(index, value, w0, w, v) -> tuple[float, np.ndarray, np.ndarray]:
    own = v[index] * value[:, None]
    sums = own.sum(axis=0)
    return float(w0 + w[index] @ value + 0.5 * (sums @ sums - (own * own).sum())), own, sums


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start() -> dict:
    r = np.random.default_rng(5)
    return {"w0": 0.0, "w": np.zeros(SIZE, np.float32), "v": r.normal(0, 0.03, (SIZE, RANK)).astype(np.float32)}


def featured(sample: DataFrame, parts: int) -> DataFrame:
    """``part, place, label, index, value``: the features of a sample, dealt to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            own = [features(t.as_py(), slots) for t in batch.column("text")]
            upto = pa.array(np.cumsum([0, *(len(i) for i, _ in own)]), pa.int32())
            index = pa.ListArray.from_arrays(upto, pa.array(np.concatenate([i for i, _ in own] or [np.empty(0)]).astype(np.int32)))
            value = pa.ListArray.from_arrays(upto, pa.array(np.concatenate([v for _, v in own] or [np.empty(0)]).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("part", "place", "label")), index, value], ["part", "place", "label", "index", "value"])

    place = F.xxhash64("doc_id", "text")
    dealt = sample.select(F.pmod(place, F.lit(parts)).cast("long").alias("part"), place.alias("place"), "label", "text")
    return dealt.mapInArrow(run, "part long, place long, label int, index array<int>, value array<float>")


def train(sample: DataFrame, rounds: int, parts: int, rate: float, decay: float) -> dict:
    spark = sample.sparkSession
    model = start()
    sample = written(featured(sample, parts), "sample")
    # Ranges finer than the parts: no task trains two of them.
    dealt = sample.repartitionByRange(4 * parts, "part").persist()

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(rows: pa.Table) -> pa.Table:
            m = shared.value  # noqa: B023
            w0, w, v = m["w0"], m["w"].copy(), m["v"].copy()
            g0, gw, gv = 1e-3, np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32)
            rows = rows.sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["index"]).to_numpy())])
            flat_index, flat_value = pc.list_flatten(rows["index"]).to_numpy(), pc.list_flatten(rows["value"]).to_numpy()
            for i, label in enumerate(rows["label"].to_pylist()):
                index, value = flat_index[upto[i] : upto[i + 1]], flat_value[upto[i] : upto[i + 1]]
                y, own, sums = margin(index, value, w0, w, v)
                slope = sigmoid(y) - label
                dw = slope * value + decay * w[index]
                dv = slope * (value[:, None] * sums - own * value[:, None]) + decay * v[index]
                g0 += slope * slope
                gw[index] += dw * dw
                gv[index] += dv * dv
                w0 -= rate * slope / g0**0.5
                w[index] -= rate * dw / np.sqrt(gw[index])
                v[index] -= 0.3 * rate * dv / np.sqrt(gv[index])
            return pa.table({"part": [rows["part"][0].as_py()], "n": [rows.num_rows], "w0": [float(w0)], "w": [w.tobytes()], "v": [v.tobytes()]})

        trained = dealt.groupBy("part").applyInArrow(run, "part long, n long, w0 double, w binary, v binary")
        found = sorted(trained.collect(), key=lambda r: r["part"])  # a row of fixed size for each part
        shared.unpersist()
        if not found:
            break
        share = [r["n"] / sum(r["n"] for r in found) for r in found]
        w = sum(p * np.frombuffer(r["w"], np.float32).astype(float) for p, r in zip(share, found))
        v = sum(p * np.frombuffer(r["v"], np.float32).astype(float) for p, r in zip(share, found)).reshape(SIZE, RANK)
        model = {"w0": sum(p * r["w0"] for p, r in zip(share, found)), "w": w.astype(np.float32), "v": v.astype(np.float32)}
    dealt.unpersist()
    return model


def classify(docs: DataFrame, labels: DataFrame, learn: Column, *, sample_rows: int = 12_000, rounds: int = 6, parts: int = 6, part_rows: int = 500, rate: float = 0.15, decay: float = 1e-5, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``; labels of rows
    where ``learn`` (of ``doc_id``) holds may be learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & learn)
    marks = marks.groupBy("doc_id").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    there = marks.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample_rows / max(1, there)) * (1 << 20)
    # At most about sample_rows pairs of numbers: small enough to send to every task, so texts aren't shuffled.
    sample = rows.join(F.broadcast(marks.filter(drawn)), "doc_id")
    # A part of few rows learns too little for its weights to be worth averaging.
    parts = max(1, min(parts, there // part_rows))
    model = train(sample, rounds, parts, rate, decay) if there else start() | {"v": np.zeros((SIZE, RANK), np.float32)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots = shared.value, Slots()
        for batch in batches:
            scores = np.array([sigmoid(margin(*features(t.as_py(), slots), m["w0"], m["w"], m["v"])[0]) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
