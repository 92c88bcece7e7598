"""Every query with SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, data, oracle, name):
    got = catalog.QUERIES[name](spark, data)
    want = oracle.sql(catalog.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    places = [want.columns.index(c) for c in order]
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert a == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


#: No SQL has their Fourier transforms of whole files, correlations and cepstra; test_comparison.py and test_rhythm.py hold them against plain versions.
WITHOUT_SQL = {"mastering_comparison", "temporal_profiles", "acoustic_vectors"}


def test_queries_have_sql():
    assert catalog.QUERIES.keys() - catalog.SQL.keys() == WITHOUT_SQL and catalog.SQL.keys() <= catalog.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_every_file_has_a_row(spark, data, name):
    found = catalog.QUERIES[name](spark, data)
    files = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("cast(vec_id div 16 as string) AS path").distinct()
    assert found.count() == files.count() and found.join(files, "path").count() == files.count()
