import random

import numpy as np
import pytest

from tessera.llm import minhash, substring_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, text_a string, label string"


def corpus(seed, n=120):
    """Texts with copies, near copies in chains and stars, shared passages and odd cases."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    passage = " ".join(r.choices(vocabulary, k=70))
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.55:
            w = r.choice(texts).split()
            for _ in range(r.randint(1, 1 + len(w) // 60)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append("  ".join(w) if r.random() < 0.2 else " ".join(w))
        else:
            w = r.choices(vocabulary, k=r.choice([1, 2, 3, 40, 49, 50, 51, 120, 400]))
            if kind > 0.8:
                w[len(w) // 2 : len(w) // 2] = passage.split()
            texts.append(" ".join(w))
    texts += ["", None, " \t\n", "One", "one", "one two", passage, passage + " x", "é É ß", "x" * 5000]
    r.shuffle(texts)
    return [(i, t, "clash", "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = minhash.near_dedup(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect()
    want = brute.near_components([r[:2] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_bucket_of_unlinked_members_is_fully_compared(spark):
    # Two clusters whose members share most of a template, so that buckets mix them.
    r = random.Random(5)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(0, 300, 24) if i % 2 else range(12, 300, 24):
            w[k] = f"c{i % 2}" if r.random() < 0.97 else f"u{i}"
        rows.append((i, " ".join(w), "", ""))
    got = minhash.near_dedup(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_components([x[:2] for x in rows])


@pytest.mark.parametrize(("seed", "hot"), [(1, 5000), (2, 3)])
def test_substrings_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA), hot=hot, shard_words=700).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring([r[:2] for r in rows])


def test_on_the_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    near = minhash.op6_minhash_near_dedup(spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near} == brute.near_components(docs)
    sub = substring_dedup.op10_substring_dedup(spark, data).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sub} == brute.substring(docs)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    text = " ".join(f"a{i}" for i in range(80))
    odd = spark.createDataFrame([(None, text, "", ""), (None, None, "", ""), (3, text, "", ""), (3, text, "", ""), (4, text, "", "")], SCHEMA)
    near = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_dedup(odd).collect())
    assert near[:3] == [("3", "3", True), ("3", "3", True), ("4", "3", False)] and len(near) == 5
    sub = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup(odd).collect())
    assert sub == [("3", 0), ("3", 0), ("4", 80), ("None", 0), ("None", 0)]


def test_intervals_of_the_index():
    r = np.random.default_rng(3)
    base = r.integers(1, 50, 300)
    runs = [base[s : s + n] for s, n in zip(r.integers(0, 200, 40), r.integers(50, 100, 40))]
    length = np.array([len(x) for x in runs])
    text = np.unique(np.concatenate([np.append(x, 0) for x in runs]), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    doc = np.repeat(r.permutation(40), length + 1)
    got = substring_dedup.FMIndex(text, doc, 50).stream(text, start, length)
    want = {}
    places = [p for s, n in zip(start, length) for p in range(s, s + n - 49)]
    for p in places:
        k = text[p : p + 50].tobytes()
        want[k] = min(want.get(k, 99), doc[p])
    assert all(got[p] == want[text[p : p + 50].tobytes()] for p in places)


def test_one_id_with_several_texts(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("x", 200), ("y", 60), ("z", 61)))
    rows = [(0, x), (1, x + " q"), (1, y), (1, y), (2, y + " q"), (2, z), (3, z + " " + y), (3, z), (None, z), (4, None), (4, z + " end")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(((i, *r) for (i, _), r in zip(rows, brute.substring_rows(rows))), key=key)
    near = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert len(near) == len(rows)
    texts = {r.n_shingles: set() for r in near}
    for r in near:
        texts[r.n_shingles].add(r.component_id)
    assert texts[198] == {0} == texts[199] == texts[58] and texts[59] == {0, None} and texts[119] == {0}  # through the ids 1, 2 and 3


def test_repeated_ids_whatever_the_order(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    x, z, y = words("x", 70), words("z", 120), words("y", 90)
    rows = [(3, x), (3, z), (4, z + " tail"), (3, z), (2, x), (9, None), (9, y), (7, y + " q"), (8, y + " r s"), (8, words("v", 40)), (11, ""), (11, ""), (2**62, words("v", 40) + " w"), (None, x)]
    want = None
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        got = minhash.near_dedup(spark.createDataFrame(order, "doc_id long, text string"), width=3, percent=85).collect()
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in got)
        assert want is None or got == want
        want = got
    own = {}
    for (null, i), _, component, kept in want:
        own.setdefault(None if null else i, set()).add(component)
        assert kept == (component == i if not null else component is None)
    assert own == {2: {2}, 3: {2}, 4: {2}, 7: {7}, 8: {7}, 9: {7}, 11: {11}, 2**62: {7}, None: {None}}


def test_very_long_texts(spark):
    text = " ".join(f"w{i * 7 % 30_011}" for i in range(300_000))
    rows = [(1, text), (2, text + " more"), (3, "x " * 200_000), (4, text[:50_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in minhash.near_dedup(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    sub = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()}
    assert sub[1] == (300_000, 0) and sub[2] == (300_001, 300_000) and sub[3] == (200_000, 0) and sub[4][1] >= sub[4][0] - 1
