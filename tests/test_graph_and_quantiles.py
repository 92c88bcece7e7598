"""Strongly connected components and exact percentiles against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, quantiles


def plain_components(edges):
    """{node: least node of its component} of the nodes on cycles, by reachability."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[a] = seen
    on = {a for a in reach if a in reach[a]}
    return {a: min(b for b in on if b in reach[a] and a in reach[b]) for a in on}


def components(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    return {r.node: r.component for r in graph.strong_components(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (300, 300)]
    assert components(spark, edges) == plain_components(edges)


def test_components_of_odd_graphs(spark):
    assert components(spark, []) == {}
    assert components(spark, [(1, 2), (None, 1), (2, None), (1, 2)]) == {}
    assert components(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "x")], "string") == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x"}
    # Two nodes joined by chains both ways, and a chain that leaves and returns to one.
    two = [(0, 10), (10, 11), (11, 1), (1, 20), (20, 0), (0, 30), (30, 31), (31, 0), (1, 40), (40, 41), (5, 0)]
    assert components(spark, two) == plain_components(two)


def test_a_long_chain_and_a_long_ring(spark):
    n = 200_000
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    assert graph.strong_components(chain).isEmpty()
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    assert [tuple(r) for r in graph.strong_components(ring).agg(F.count("*"), F.min("component"), F.max("component")).collect()] == [(n, 0, 0)]


@pytest.mark.parametrize("small", [3, 100_000])
def test_percentiles_are_exact(spark, small):
    r = np.random.default_rng(1)
    groups = {"normal": r.normal(size=3000), "ties": r.integers(0, 3, 2000).astype(float), "one": np.array([4.5]), "same": np.full(50, -2.0), "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 500), -(10.0 ** r.uniform(-300, 300, 500)), [1.7e308, -1.7e308]]), None: np.array([1.0, 2.0, 4.0, 8.0])}
    rows = [(k, float(v), 1) for k, own in groups.items() for v in own] + [("normal", None, 1), ("ties", float("nan"), 1), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {row.k: row for row in quantiles.percentiles(df, ["k"], "x", shares, small=small).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        assert got[k].n == len(own)
        for name, q in shares.items():
            assert getattr(got[k], name) == pytest.approx(np.percentile(own, 100 * q), rel=1e-12)
    assert quantiles.percentiles(df.limit(0), ["k"], "x", shares, small=small).count() == 0
