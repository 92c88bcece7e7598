"""Operator 6, MinHash near-dedup by min-max hashing.

Of each permutation both the least and the greatest value are kept, so 40
permutations give 80 signature values for the cost of 40. A band takes two
minima and two maxima of four permutations; 20 bands of four values miss a pair
of similarity 0.85 once in some two million.

Documents with equal shingle sets form a class, and one of each takes part.
In each bucket of a band the members are compared with the least one, on full
sets. Buckets whose members then lie in several components are refined: two
texts that are similar enough share one of their rarest shingles, so those of
all such members are dealt to groups by shingle, and each group compares one
member of every component with the members of the others, until no group holds
an untried pair across components. So a large group of near copies costs one
comparison a member, texts that merely share a template aren't compared, and
no link between two components is lost to a shortcut.

Defined cases: a text without words, or null, has an empty set and is linked
with nothing; with fewer words than a shingle has, all of them are its one
shingle; rows that repeat an id are one document, linked by any of their texts, so they have one
component, while each row has the size of its own text's set; a row without an id is no document, gets
no component and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.components import components

PERMUTATIONS = 40
BANDS = PERMUTATIONS // 2
BLOCK = 4096  # shingles hashed at once
CACHED_WORDS = 300_000
HUB_PART = 512  # members that are compared with one copy of their hub's text


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: bytes know no other letters and no other white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(len(words), width)):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The minima under each permutation, then the maxima."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(shingles), BLOCK):
        values = a[:, None] * shingles[None, i : i + BLOCK]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band; every signature value lies in one band."""
    low, high = signature[:PERMUTATIONS], signature[PERMUTATIONS:]
    b = np.arange(BANDS)
    key = b.astype(np.uint64) + np.uint64(1)
    for part in (low[b], low[b + BANDS], high[(b + BANDS // 2) % PERMUTATIONS], high[(b + BANDS // 2 + BANDS) % PERMUTATIONS]):
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def key_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_keys(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, set_key, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys = [key_of(shingle_hashes(words_of(t.as_py()), hashes, width)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), batch.column("text")], ["doc_id", "set_key", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, text string")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, a = WordHashes(), multipliers()
        for batch in batches:
            sizes, keys, bands, offsets = [], [], [], [0]
            for text in batch.column("text"):
                s = shingle_hashes(words_of(text.as_py()), hashes, width)
                sizes.append(len(s))
                keys.append(key_of(s))
                if len(s):
                    bands.append(band_keys(min_max(s, a)))
                offsets.append(len(bands) * BANDS)
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a, b``) whose full shingle sets are similar enough. The members of a hub ``b`` are dealt to parts of some ``HUB_PART``;
    each part gets the hub's text once, before its members'."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / HUB_PART))
    dealt = pairs.join(pairs.groupBy("b").agg(F.count("*").alias("n")), "b").select("a", "b", F.pmod(F.hash("a"), parts).alias("part"))
    members = dealt.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("b", "part", F.lit(1).alias("place"), "a", "text")
    hubs = dealt.select("b", "part").distinct().join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("b", "part", F.lit(0).alias("place"), F.col("b").alias("a"), "text")
    rows = members.union(hubs).repartition("b", "part").sortWithinPartitions("b", "part", "place")

    def full_set(text: str) -> set:
        w = words_of(text)
        return set(zip(*(w[i:] for i in range(width)))) if len(w) >= width else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            keep = []
            for i, (place, text) in enumerate(zip(batch.column("place").to_pylist(), batch.column("text"))):
                own = full_set(text.as_py())
                if not place:
                    hub = own
                    continue
                least, most = sorted((len(own), len(hub)))
                if 100 * least < percent * most:
                    continue
                both = len(own & hub)
                if 100 * both >= percent * (len(own) + len(hub) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int32())) for k in ("a", "b")], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``shingle, rep, n, core``: of each text of ``texts`` the rarest shingles,
    so many that two texts which are similar enough share one of them; ``core``
    marks those of which one must be shared with a text that isn't smaller.

    Rarity is the number of texts with the shingle, then its hash. Shingles that
    one text has alone come first and match nothing, so they are only counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(words_of(t.as_py()), hashes, width) for t in batch.column("text")]
            upto = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["rep", "shingles"])

    sets = written(texts.select("doc_id", "text").mapInArrow(run, "rep long, shingles array<long>"), "shingles")
    each = sets.select("rep", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    common = written(each.groupBy("shingle").agg(F.count("*").alias("docs")).filter("docs > 1"), "common")
    own = each.join(common, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    least = F.floor((percent * F.col("n") + 99) / 100)  # shared by texts that are similar enough
    both = F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent))  # and with one that isn't smaller
    own = own.withColumn("long", F.col("n") - least + 1 - alone).withColumn("short", F.col("n") - both + 1 - alone).filter("long > 0")
    kept = own.select("rep", "n", "short", F.posexplode(F.slice("shared", 1, F.col("long").cast("int"))).alias("at", "x"))
    return kept.select("x.shingle", "rep", "n", (F.col("at") < F.col("short")).alias("core"))


def near_dedup(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``:
    documents linked, directly or through others, by shingles of ``width`` words
    with a Jaccard similarity of ``percent`` hundredths or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(rows, width), "signed")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    own_key = F.xxhash64("set_key")
    repeated = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), (F.min(own_key) != F.max(own_key)).alias("several"))
    repeated = written(repeated.filter("rows > 1").select("doc_id", "several"), "repeated")
    again = not repeated.isEmpty()
    if again:
        # An id with several sets can't name a class. A class that only such ids have is named by its set.
        named = filled.join(repeated, "doc_id", "left").withColumn("name", F.expr("if(coalesce(several, false), null, doc_id)"))
        classes = named.groupBy("set_key").agg(F.min("name").alias("name")).select("set_key", F.coalesce("name", own_key).alias("rep"), F.col("name").isNull().alias("by_set"))
    else:
        classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")).withColumn("by_set", F.lit(False))
    classes = written(classes, "classes")

    # Buckets of class representatives: those with two members or more.
    reps = signed.join(classes, "set_key").filter("by_set or doc_id = rep").select("rep", "bands")
    entries = reps.select("rep", F.explode("bands").alias("band")).distinct()
    buckets = written(entries.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub <> last").select("band", "hub"), "buckets")
    members = written(entries.join(buckets, "band"), "members")
    texts = rows
    if again:
        # One text for each class: of ids that repeat, by the set.
        first = set_keys(rows.join(repeated, "doc_id", "left_semi"), width).join(classes, "set_key").filter("by_set or doc_id = rep").groupBy("rep").agg(F.min("text").alias("text"))
        texts = rows.join(repeated, "doc_id", "left_anti").union(first.select(F.col("rep").alias("doc_id"), "text"))
    texts = written(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    tried = written(members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    found = linked(tried, texts, width, percent)
    if again:  # the texts of an id are linked through it
        found = found.union(filled.join(repeated.filter("several"), "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = written(found, "found")
    labels = components(found)
    # Only members of buckets that still hold several components go on.
    named = members.join(labels, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    several = named.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("band")
    open_ = named.join(several, "band", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    entries = written(prefixes(texts.join(open_, "doc_id", "left_semi"), width, percent), "prefixes")
    used = None
    while True:
        # What no hub of its shingle was compared with, in two or more components.
        rest = entries if used is None else entries.join(used, ["shingle", "rep"], "left_anti")
        rest = rest.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        rest = written(rest, "open")
        several = rest.groupBy("shingle").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("shingle")
        hubs = rest.join(several, "shingle", "left_semi").groupBy("shingle", "label").agg(F.min(F.struct("rep", "n", "core")).alias("hub"))
        hubs = written(hubs.select("shingle", F.col("label").alias("hub_label"), F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.core").alias("hub_core")), "hubs")
        if hubs.isEmpty():
            break
        more = rest.join(hubs, "shingle").filter("label <> hub_label").filter(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
        more = more.filter("case when n < hub_n then core when n > hub_n then hub_core else core and hub_core end")
        more = more.select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
        more = written(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = written(tried.union(more), "tried")
        found = written(found.union(linked(more, texts, width, percent)), "found")
        labels = components(found)
        now = hubs.select("shingle", F.col("hub").alias("rep"))
        used = written(now if used is None else used.union(now), "used")

    named = signed.join(classes, "set_key", "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    named = named.select("doc_id", "n_shingles", component.alias("component_id"))
    if again:  # names that are no ids give way to the least id
        named = written(named, "named")
        least = named.filter("n_shingles > 0 and doc_id is not null").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        named = named.join(least, "component_id", "left").withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("component_id")))
        # The rows of an id without words share the component of those with words.
        several = named.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        named = named.join(several.join(repeated, "doc_id", "left_semi"), "doc_id", "left").withColumn("component_id", F.coalesce("own", "component_id"))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.r < y.r GROUP BY 1, 2)
  JOIN n l ON l.r = a JOIN n r ON r.r = b WHERE 100 * c >= 85 * (l.n + r.n - c)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
  UNION ALL SELECT x.r, y.r FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.r <> y.r
), reach AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), c AS (
  SELECT a AS r, min(doc_id) AS least FROM reach JOIN d ON d.r = b GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
