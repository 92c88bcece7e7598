"""The operators with SQL: against DuckDB on the documents, and on odd cases."""

import pathlib
import textwrap

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, license_scan, line_dedup, mixing, quality_rules, queries

ODD = [
    (1, "a  b\n\nc d\nx", "en", "s1"), (2, "a b c d x", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, "a\tb c\nd x", None, None),
    (6, " \t\n\r\x0b\x0c ", "en", "s2"), (7, "word " * 40000, "en", "s2"), (8, "l1\nl2\nl3\nl4", "en", "s1"), (9, "l1\nl2\nl3\nz", "en", "s1"), (9, "l1\nl2\nl3\nz", "en", "s1"),
    (None, "a b c d x", "en", "é"), (11, "#*$%&|<> é ß 漢字", "de", "é"), (12, "one two three one two three one two", "en", "s1"), (13, "\n\n\n\n", "en", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"n_chars": F.length("text").cast("long"), "h": F.lit("clash"), "host": F.lit(1), "key": F.lit(2), "norm": F.lit("x"), "bad": F.lit(0), "rank": F.lit(0)})


def same(got, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)

    def rows(df):
        text = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else f"{v:.9g}" if isinstance(v, float) else str(v)
        return sorted(tuple(map(text, r)) for r in df[order].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql_on_the_documents(spark, data, name):
    sql = queries.SQL[name]
    got = queries.QUERIES[name](spark, data).toPandas()
    same(got, sql, **{t: duckdb.connect().sql(f"select * from '{data}/{t}.parquet'").arrow().read_all() for t in ("documents", "pages")})


@pytest.mark.parametrize("name", ["op1_line_dedup", "op7_mixing", "op8_quality_rules", "op9_exact_dedup"])
def test_equals_sql_on_odd_rows(spark, odd, tmp_path, name):
    keep = odd.filter("doc_id is not null and doc_id <> 9")  # a missing or repeated id has its own tests
    keep.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    same(got, queries.SQL[name], documents=duckdb.connect().sql(f"select * from '{tmp_path}/documents.parquet/*.parquet'").arrow().read_all())


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, mixing.mix, quality_rules.quality_rules, line_dedup.line_dedup])
def test_every_row_has_a_result(operator, odd):
    assert operator(odd).count() == len(ODD)
    assert operator(odd.limit(0)).count() == 0


def test_collisions_are_told_apart(spark):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(60)], "doc_id long, text string")
    weak = exact_dedup.exact_dedup(rows, hash_of=lambda c: F.substring(F.md5(c), 1, 0))
    for r in weak.collect():
        assert r.keep_id == r.doc_id % 7 and r.group_size == len([i for i in range(60) if i % 7 == r.doc_id % 7]) and r.kept == (r.doc_id < 7)


def test_null_ids_join_their_group(odd):
    got = exact_dedup.exact_dedup(odd).filter("doc_id is null").first()
    assert got.keep_id == 1 and got.group_size == 4 and not got.kept


def test_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([("a1", 1, 1), ("a2", 100, 5), ("a3", 1000, 9)], "key string, source_size long, n long")
    got = {r.key: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a1"] == 3 and got["a2"] == 300 and abs(sum(got.values()) - 1101) < 1e-6


def test_mix_comes_near_its_targets_whatever_the_bins(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    fine, coarse = (mixing.mix(docs, bins=b).orderBy("doc_id").collect() for b in (1024, 3))
    assert fine == coarse
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    by = {}
    for r in fine:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    for rows in by.values():  # many sources have one target
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1


def test_inclusion_probabilities_give_the_remainder(spark):
    sizes = [("a", 1, 40), ("a", 9, 5), ("a", 400, 1), ("b", 10, 3), ("c", 100, 1), ("c", 1, 10)]
    rest = {"a": 430.0, "b": 29.0, "c": 5.0}
    rows = spark.createDataFrame([(*s, rest[s[0]]) for s in sizes], "key string, size long, n long, rest double")
    scale = {r.key: r.scale for r in mixing.inclusion_scales(rows).collect()}
    for key, words in rest.items():
        chance = {s: min(1.0, scale[key] * s**0.5) for k, s, _ in sizes if k == key}
        assert abs(sum(chance[s] * s * n for k, s, n in sizes if k == key) - words) < 1e-9 * words
    assert scale["a"] * 400**0.5 > 1  # the long document is certain


def test_carried_rows_have_the_copies_of_their_ids(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert {r.row.doc_id: r.copies for r in mixing.mix(docs, carry=True).collect()} == plain


def test_lines_of_many_documents_go(spark):
    filler = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Accept  our COOKIES\n{filler(i)}", "s") for i in range(30)] + [(100 + i, "only menu\nonly menu", "s") for i in range(2)]
    rows += [(200 + i, filler(999), "s") for i in range(40)] + [(300, "accept our cookies\n" * 30, "t")]
    rows += [(400, filler(999) + "\n" + filler(7)[:200], "s"), (500, filler(500) + "\n" + filler(999) + "\n\n" + filler(501), "s")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), cleaned=True).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 3 and got[i].text == filler(i) for i in range(30))
    assert all(not got[200 + i].kept and not got[200 + i].base_failed and got[200 + i].n_removed_words == 60 for i in range(40))  # depleted
    assert got[300].base_failed and not got[300].n_removed_words
    assert not got[400].kept and not got[400].base_failed and got[500].kept and got[500].text == filler(500) + "\n\n" + filler(501)


def test_documents_of_a_line_are_distinct(spark):
    text = lambda i: f"shared line\n{i}"
    rows = [(1, text(0), "s")] * 50 + [(i, text(i), "s") for i in range(2, 21)] + [(None, text(0), "s")] * 50
    count = lambda rows: quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("n_removed_words > 0").count()
    assert count(rows[:-50]) == 0  # 20 documents
    assert count(rows) == 119  # 21 with the one without an id
    assert quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_docs=1, min_docs=1).filter("n_removed_words > 0").count() == 119


def test_a_filter_on_the_verdict_does_not_repeat_the_counts(spark):
    # A filter that moved below the counts would take hours on texts of this length.
    text = " ".join(f"w{i % 9000}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, "short", "s"), (3, None, None)], "doc_id long, text string, source string")
    judged = quality_rules.quality_rules(docs, cleaned=True, carry=True)
    assert [(r.doc_id, r.n_repeat_words) for r in judged.filter("not kept").orderBy("doc_id").collect()] == [(1, 20_000), (2, 0), (3, 0)]
    assert judged.filter("kept").count() == 0


def test_licences_by_canonical_text(spark):
    mit = license_scan.LICENSES["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence"), mit + " more", None, "", "released under the mit licence", "Licensed under the Apache License, Version 2.0"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, license_id string, h int")
    known = license_scan.known_licenses(spark)
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(docs, known).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: "MIT-notice", 6: "Apache-2.0-notice"}
    lines = spark.createDataFrame([(1, "text\nAll rights reserved.\nReleased under the MIT License.\nall rights reserved"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.license_id, r.n_lines) for r in license_scan.license_notices(lines, known).collect()} == {("all-rights-reserved", 2), ("MIT-notice", 1)}


def test_licence_files_with_titles_and_owners(spark):
    known, texts = license_scan.known_licenses(spark), license_scan.LICENSES
    wrapped = "\n".join(textwrap.wrap(texts["MIT"], 70))
    files = {
        "MIT": [f"MIT License\n\nCopyright (c) 2019-2021 A, B and C\n\n{texts['MIT']}", f"The MIT License (MIT)\n\nCopyright The X Authors\n\n{wrapped}", f"Copyright by X.\nAll rights reserved.\n\n{wrapped}"],
        "BSD-3-Clause": [f"BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n{texts['BSD-3-Clause']}", f"Copyright 2017 X. All rights reserved.\n\n{texts['BSD-3-Clause'].replace('1.', '  *').replace('2.', '  *').replace('3.', '  *')}"],
        "ISC": [f"ISC License\n\nCopyright 2020 X\n\n{texts['ISC']}"],
        "Unlicense": [texts["Unlicense"].replace("https", "http")],
        "WTFPL": ["            " + texts["WTFPL"]],
    }
    rows = [(i, text, name) for i, (name, text) in enumerate((n, t) for n, ts in files.items() for t in ts)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, want string").drop("want"), known).collect()
    found = {r.doc_id: r.license_id for r in got}
    numbered = [i for i, t, n in rows if n == "BSD-3-Clause"][1]
    assert {i: n for i, _, n in rows if i != numbered} == {i: n for i, n in found.items() if i != numbered}
    assert found[numbered] is None  # other list marks are another text
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [(n, pathlib.Path(folder, f).read_text()) for f, n in names.items() if pathlib.Path(folder, f).exists()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(there)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in license_scan.license_scan(docs, known).collect()} == {i: n for i, (n, _) in enumerate(there)}


# One id with several texts, rows that repeat id and text, and rows without an id.
A, B, C = ("\n".join(f"{w}{i} {w}{i} tail" for i in range(30)) for w in "abc")
AGAIN = [(1, A, "en", "s1"), (1, B, "en", "s2"), (2, A + "\nz", "en", "s1"), (2, B, "en", "s1"), (2, B, "en", "s1"), (None, A, None, None), (None, C, None, None), (3, C, "en", "s1"), (3, None, "en", "s1"), (3, "", "en", "s1")]


def test_line_dedup_of_repeated_ids_equals_sql(spark, tmp_path):
    spark.createDataFrame(AGAIN + ODD, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_line_dedup"](spark, str(tmp_path)).toPandas()
    same(got, queries.SQL["op1_line_dedup"], documents=duckdb.connect().sql(f"select * from '{tmp_path}/documents.parquet/*.parquet'").arrow().read_all())
    out = line_dedup.line_dedup(spark.createDataFrame([(1, "a\nb\nc\nd", ""), (1, "u\nv\nw\nx", ""), (2, "a\nb\nc\nd", "")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in out) == [(1, 0, "a\nb\nc\nd"), (1, 0, "u\nv\nw\nx"), (2, 4, "")]


def test_exact_groups_of_repeated_ids(spark):
    for weak in (False, True):
        docs = spark.createDataFrame(AGAIN, SCHEMA)
        hashed = {"hash_of": lambda c: F.substring(F.md5(c), 1, 0)} if weak else {}
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, **hashed).collect())
        # A: 1 and null; B: 1, 2, 2; C: null, 3; A with a line more: 2; the two empty ones: 3, 3
        want = [("1", "1", 2, True), ("None", "1", 2, False), ("1", "1", 3, True), ("2", "1", 3, False), ("2", "1", 3, False), ("None", "3", 2, False), ("3", "3", 2, True), ("2", "2", 1, True), ("3", "3", 2, True), ("3", "3", 2, True)]
        assert got == sorted(want)


@pytest.mark.parametrize("operator", [mixing.mix, quality_rules.quality_rules, line_dedup.line_dedup, exact_dedup.exact_dedup])
def test_repeated_ids_add_no_rows(operator, spark):
    assert operator(spark.createDataFrame(AGAIN, SCHEMA)).count() == len(AGAIN)


def test_texts_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 5000} of it" for i in range(60_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, text + "\nlast", "s"), (3, "x " * 400_000, "s")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs).collect()} == {1: (60_000, 55_000), 2: (60_001, 60_000), 3: (1, 0)}
    judged = {r.doc_id: r for r in quality_rules.quality_rules(docs, min_docs=1, cleaned=True).collect()}
    assert judged[1].text == "" and judged[2].text == "last" and judged[2].n_removed_words == 240_000 and not judged[3].n_removed_words
    assert license_scan.license_scan(docs, license_scan.known_licenses(spark)).filter("license_id is null").count() == 3


def test_few_and_many_frequent_lines_give_the_same_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(spark.createDataFrame(AGAIN, SCHEMA).withColumn("n_chars", F.lit(0).cast("long")))
    few, many = (sorted(map(str, quality_rules.quality_rules(docs, min_docs=1, most_docs=3, few=n, cleaned=True).collect())) for n in (10_000, 0))
    assert few == many and any("n_removed_words=0" not in r for r in few)
