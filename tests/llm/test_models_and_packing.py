import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language_id, packing, quality_classifier, queries
from tests.llm import brute


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(pieces, texts, tokenizer, window=1024):
    """``texts``: (doc_id, text) with distinct ids. Every id lies in one piece; sequences are gapless."""
    ids = {i: np.array([*e.ids, 0], "<u4") for (i, _), e in zip(texts, tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False))}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and at & (at - 1) == 0  # nothing is padded


def test_packing_of_the_documents(spark, data, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check_pieces(queries.QUERIES["op3_packing"](spark, data).collect(), docs, tokenizer)


def test_packing_of_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "a", "x" * 9000, "é漢😀 ", "tab\tnew\n\n line  two ", "a" * 1023, "in\x00side blank", *["same text here"] * 50]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, ids long, length string")
    check_pieces(packing.packed(docs, shard_tails=20).collect(), rows, tokenizer)
    assert packing.packed(docs.limit(0)).count() == 0


def test_token_ids_equal_the_json_vocabulary(tokenizer):
    r = random.Random(3)
    texts = ["".join(r.choices("ab .,'!\n\t\r\x0b  é漢😀1-_  \x1c\x85", k=r.randint(0, 60))) for _ in range(3000)]
    added = "<|endoftext|>"  # one token wherever it stands
    texts += ["".join(r.choices(["a", " ", "b ", "\n", ".", added, added[:-1], "é"], k=r.randint(0, 20))) for _ in range(1000)] + [f"a {added} b", added, f"x{added}{added}  y  {added}\n z {added[:-1]}"]
    flat, upto = packing.encode_batch(pa.array(texts), packing.vocabulary_path())
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert flat[upto[i] : upto[i + 1]].tolist() == e.ids


def test_neighbours_share_a_window():
    r = np.random.default_rng(1)
    topics = [r.integers(100 * t, 100 * t + 100, (6, 250)) for t in range(4)]
    tails = [topics[i % 4][i // 4].astype(np.uint32) for i in range(24)]
    sequences = packing.pack_shard(tails, np.ones(400, np.float32), 250.0, 1000)
    assert all(len({t % 4 for t, _, _ in s}) == 1 for s in sequences[:4])
    assert sorted(t for s in sequences for t, a, b in s for _ in range(a, b)) == sorted(t for t in range(24) for _ in range(250))


def test_short_tails_of_a_topic_share_windows():
    # A window takes a hundred of these tails, and each topic has enough for two windows.
    r = np.random.default_rng(5)
    topic = r.permutation(np.arange(800) % 4)
    tails = [np.append(r.permutation(20)[:9] + 20 * t, 80 + t).astype(np.uint32) for t in topic]
    sequences = packing.pack_shard(tails, np.ones(84, np.float32), 10.0, 1000)
    assert len(sequences) == 8 and all(len({topic[t] for t, _, _ in s}) == 1 for s in sequences)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packs_as_the_plainest_greedy_packer(seed):
    r = np.random.default_rng(seed)
    tails = [np.concatenate([r.integers(0, 40, r.integers(1, 30)) + 40 * r.integers(0, 3), r.integers(120, 400, r.integers(0, 8))]).astype(np.uint32) for _ in range(150)]
    idf = r.integers(1, 9, 400).astype(np.float32)
    mean = float(np.mean([len(t) for t in tails]))
    index = packing.Index(tails, idf, mean)
    weights = {}
    for i, t in enumerate(tails):
        for term, count in zip(*np.unique(t, return_counts=True)):
            weights[term, i] = float(idf[term]) * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * len(t) / mean))
    assert all(np.allclose(index.scores(i), [sum(weights.get((t, k), 0.0) for t in set(tails[i].tolist())) for k in range(150)]) for i in range(0, 150, 7))
    assert packing.pack_shard(tails, idf, mean, 128) == brute.pack([t.tolist() for t in tails], lambda t, i: weights.get((t, i), 0.0), 128)


def test_all_places_are_ranked():
    score = np.random.default_rng(6).integers(0, 30, 500).astype(float)
    want = sorted(np.flatnonzero(score).tolist(), key=lambda i: (-score[i], i))
    assert list(packing.ranked(score)) == want and list(packing.ranked(score[:7])) == [i for i in want if i < 7]
    assert list(packing.ranked(np.zeros(40))) == []


def test_bm25_of_the_index_equals_brute_force():
    r = np.random.default_rng(2)
    tails = [r.integers(0, 60, n).astype(np.uint32) for n in (5, 50, 300, 20, 1)]
    idf = r.random(60).astype(np.float32)
    index = packing.Index(tails, idf, 75.0)
    for i in range(5):
        want = [sum(idf[t] * (c := (x == t).sum()) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / 75.0)) for t in index.queries[i]) for x in tails]
        assert np.allclose(index.scores(i), want)


def test_the_query_has_all_ids_of_the_seed():
    r = np.random.default_rng(7)
    idf = np.concatenate([np.full(200, 1.0), np.full(3000, 9.0)]).astype(np.float32)
    # Each tail has 30 rare ids of its own and 60 of the 100 frequent ids of its topic.
    tails = [np.concatenate([200 + 30 * i + np.arange(30), 100 * (i % 2) + r.permutation(100)[:60]]).astype(np.uint32) for i in range(40)]
    index = packing.Index(tails, idf, 90.0)
    want = [sum(idf[t] * 2.2 / (1 + 1.2) for t in np.intersect1d(x, tails[3])) for x in tails]
    assert np.allclose(index.scores(3), want)
    mixed = [tails[i] for i in r.permutation(40)]
    topic = [int(x[-1]) // 100 for x in mixed]
    sequences = packing.pack_shard(mixed, idf, 90.0, 900)
    assert len(sequences) == 4 and all(len({topic[t] for t, _, _ in s}) == 1 for s in sequences)


def test_languages_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op4_language_id"](spark, data).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    rows = [(i, t, lang) for lang, words in (("aa", "kala mila tona"), ("bb", "xyzzy qwert plugh")) for i, t in enumerate([words] * 20)] + [(50, None, None), (51, "12 !? \n", None), (52, "kala TONA " * 20000, None), (53, "", "aa")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, v string")
    got = {r.doc_id: r for r in language_id.identify(docs, F.lit(True)).filter("doc_id >= 50").collect()}
    assert [got[i].lang_pred for i in range(50, 54)] == ["und", "und", "aa", "und"]
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"} and language_id.identify(docs.limit(0), F.lit(True)).count() == 0


def test_quality_of_held_out_documents(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries.QUERIES["op5_quality_classifier"](spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in held)


def test_scores_do_not_depend_on_the_partitions(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    learn = F.col("doc_id") % 5 != 0
    one, many = ({r.doc_id: r.score for r in quality_classifier.classify(docs.repartition(n), labels.repartition(n), learn, part_rows=20, rounds=2).collect()} for n in (1, 7))
    assert one == many and len(one) == docs.count()
    one, many = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.repartition(n), learn, passes=2).collect()} for n in (1, 7))
    assert one == many


def test_of_several_labels_the_majority_counts(spark):
    docs = spark.createDataFrame([(i, f"good{i % 7} text" if i % 2 else f"bad{i % 7} words") for i in range(80)] + [(1, "another text of that id")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(80)]
    noisy = [(i, 1 - q) for i, q in labels if i % 3 == 0] + [x for x in labels if x[0] % 3 == 0] * 2
    fit = lambda rows: {(r.doc_id, r.score) for r in quality_classifier.classify(docs, spark.createDataFrame(rows, "doc_id long, quality int"), F.lit(True)).collect()}
    assert fit(labels) == fit(labels + noisy) and len(fit(labels)) == 81


def test_scores_equal_a_plain_machine():
    r = np.random.default_rng(8)
    w, v = r.normal(0, 0.1, quality_classifier.SIZE), r.normal(0, 0.1, (quality_classifier.SIZE, 8))
    for text in ("One two, two three.\nOne two 3 # é\n", "", "word", "a b c d e f g h " * 5):
        index, value = quality_classifier.features(text, quality_classifier.Slots())
        plain = {}
        for word in text.encode().lower().split():
            slot = quality_classifier.Slots()[word]
            plain[slot] = plain.get(slot, 0) + 1
        n = max(1, len(text.split()))
        hashed = {int(i): float(x) for i, x in zip(index, value) if i < quality_classifier.HASHED}
        assert hashed == pytest.approx({i: (c / n) ** 0.5 for i, c in plain.items()})
        got = quality_classifier.sigmoid(quality_classifier.margin(index, value, 0.1, w, v)[0])
        assert np.isclose(got, brute.machine_score(dict(zip(index.tolist(), value.tolist())), 0.1, w, v))


def test_languages_equal_the_plain_nearest_centroid(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(12).collect()] + ["Ä b", "x", "12"]
    r = np.random.default_rng(9)
    idf = r.uniform(1, 5, language_id.DIMENSIONS).astype(np.float32)

    def slot(gram):
        codes = [ord(c) for c in gram] + [0, 0]
        h = codes[0] + codes[1] * 0x1F123BB5 + codes[2] * 0x5BD1E995 + (len(gram) - 1 << 40)
        return (h * 0x9E3779B97F4A7C15 % 2**64) >> 50

    plain = [brute.language_vector(t, slot, idf) for t in texts]
    for text, want in zip(texts, plain):
        got = language_id.vector(text, idf)
        assert (got is None) == (want is None)
        if want is not None:
            assert {int(i): float(got[i]) for i in np.flatnonzero(got)} == pytest.approx(want, rel=1e-4)


def test_the_sum_of_squares_identity():
    r = np.random.default_rng(4)
    w, v, index, value = r.random(9), r.random((9, 3)), np.array([1, 4, 5, 8]), r.random(4)
    pairs = sum((v[index[i]] @ v[index[j]]) * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(quality_classifier.margin(index, value, 0.5, w, v)[0], 0.5 + w[index] @ value + pairs)


def test_quality_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "word " * 50000, "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.classify(docs, labels, F.lit(True)).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_stages_of_the_pipeline(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("extra", F.lit(1))
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], data).write.parquet(f"{tmp_path}/{name}")
        held.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(sorted(d.columns) == sorted(columns) for d in held[:-1])
    source, judged, single, distinct, mixed, packed = ([r.asDict() for r in d.collect()] for d in held)
    verdict = {r.doc_id: r.kept for r in queries.QUERIES["op8_quality_rules"](spark, data).collect()}
    assert {r["doc_id"] for r in judged} == {i for i, k in verdict.items() if k}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in judged:
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in single} == set(first.values())
    groups = brute.near_components([(r["doc_id"], r["text"]) for r in single], 5, 80)
    assert {r["doc_id"] for r in distinct} == {c for _, c in groups.values()}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in distinct}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    tokens = {}
    for r in packed:
        tokens.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert all(n == copies[i] * each for i, (n, each) in tokens.items())


def test_stages_take_odd_rows_and_clashing_columns(spark):
    text = lambda i: " ".join(f"w{i}a{k}" for k in range(60))
    rows = [(1, text(1), "en", "s", 5), (None, text(2), None, None, None), (None, text(1), "en", "s", None), (3, None, "en", "s", 0), (4, "", "en", None, 0), (5, text(5), "en", "s", 9), (5, text(5), "en", "s", 9), (6, text(6) + " \n" + text(6), "en", "é", 3), (7, "word " * 60000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("row", "kept", "copies", "bad", "h", "size", "rep", "label", "_words", "a.b")})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(i, t) for i, t in left} <= {(1, text(1)), (None, text(2)), (5, text(5))} and left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_exact_stage_keeps_one_row_of_each_text(spark):
    rows = [(5, "same  text", "s1")] * 3 + [(5, "same text", "s2"), (5, "other text", "s1")] + [(None, "no id", s) for s in ("s2", "s1", "s1")]
    rows += [(None, "with id", "s1"), (7, "with id", "s1"), (8, "with id", "s1"), (None, None, "s1"), (None, "", None), (9, "alone", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit("clash"), "sha": F.lit(1), "a.b": F.lit(2)})
    got = corpus_pipeline.exact(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((str(r.doc_id), r.text or "", str(r.source)) for r in got.collect())
    assert [k[:2] for k in kept] == [("5", "other text"), ("5", "same  text"), ("7", "with id"), ("9", "alone"), ("None", ""), ("None", "no id")]
    assert kept[-1][2] == "s1"


def test_models_take_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "kala mila tona", "aa"), (1, "xyzzy qwert plugh", "bb"), (1, "kala mila tona", "aa"), (None, "kala tona", None), (2, None, "aa"), (3, "", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, place int").withColumn("ids", F.lit(1))
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.identify(docs, F.lit(True)).collect())
    assert got == [("1", "aa"), ("1", "aa"), ("1", "bb"), ("2", "und"), ("3", "und"), ("None", "aa")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(docs.withColumn("label", F.lit("clash")), labels, F.lit(True)).count() == len(rows)
    pieces = packing.packed(docs).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == ["1", "1", "1", "2", "3", "None"]
