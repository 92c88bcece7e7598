"""A task's share of a batch of searches: right, and within its bound of memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import search


@pytest.mark.parametrize("queries, rows, exclude", [(300, 2000, True), (300, 2000, False), (3, 4, True), (0, 5, True), (4, 0, True)])
def test_best_of_equals_a_full_sort(monkeypatch, queries, rows, exclude):
    monkeypatch.setattr(search, "SCORES", 9000)
    r = np.random.default_rng(8)
    vectors = r.integers(-2, 3, size=(rows, 8)).astype(np.float32)  # many ties
    ids, q = np.arange(queries, dtype=np.int64) * 5, vectors[:queries].astype(np.float64) if queries <= rows else r.normal(size=(queries, 8))
    order = r.permutation(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(o), pa.array(list(vectors[o]), pa.list_(pa.float32()))], ["vec_id", "embedding"]) for o in np.array_split(order, 3)]
    got = [(int(a), int(b), float(c)) for part in search.best_of(iter(batches), ids, q, 10, exclude) for a, b, c in zip(*part)]
    want = []
    for i, v in zip(ids, q):
        scores = vectors.astype(np.float64) @ v
        best = [j for j in np.lexsort((np.arange(rows), -scores)) if not exclude or j != i][:10]
        want += [(int(i), int(j), float(scores[j])) for j in best]
    assert sorted(got) == sorted(want)


def test_scores_are_bounded():
    """4,096 queries, the most of a block, over 20,000 rows in batches as Spark makes them."""
    r = np.random.default_rng(9)
    q = r.normal(size=(4096, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(r.normal(size=640_000)), 64).cast(pa.list_(pa.float64()))], ["vec_id", "embedding"])
    tracemalloc.start()
    found = sum(len(ids) for ids, _, _ in search.best_of(iter([batch, batch]), np.arange(4096), q, 10, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 40_960 and peak < 40e6
