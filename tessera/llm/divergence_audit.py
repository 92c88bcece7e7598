"""Operator 13, source divergence audit: which sources of a language use other
words than the rest, by iceberg prefix refinement.

A language keeps the terms that at least ``least`` of its documents have. They are found
level by level. The first level counts the documents of every prefix of
``FIRST_BYTES`` bytes, and of the terms that are no longer; each further level
doubles the length and looks only at terms whose last prefix reached the threshold,
since a term can't have more documents than its prefix. Levels end when every prefix
that is left is a complete term.

Each document's distinct terms and their occurrences are written once, in blocks of documents that number
their terms, so a level works on arrays of numbers. What the documents of a block and a task have in common
is summed before it is shuffled: a level moves a row for each prefix and task, whatever the number of documents. Surviving prefixes go to the tasks of the next level as a filter of ``FILTER_BITS``
bits, a size that doesn't grow with the data. The filter may let a
rare prefix pass, which costs one more count and changes no result: terms are kept by their exact counts only.
A last pass counts the occurrences of the kept terms, and of few others that the filter lets pass, by source.

Divergences of all pairs of sources are sums over kept terms, made in blocks of
``TILE`` sources by as many: a task holds one block of sums at a time. The result itself has a row
for each two sources of a language. Smoothed shares are whole numbers, computed as
decimals, so counts of any size are exact.

Defined cases: null text, language or source count as empty; a row is a document,
so rows that repeat an id count each; a group without terms has the shares that smoothing gives;
where a language keeps no term, its sources differ by 0; ties are ranked by the item's bytes; a term of
any length is one term; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table, written
from tessera.llm.packing import slices

#: Terms are runs of letters and of bytes beyond ASCII: A-Z become a-z, other bytes end a term.
AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FIRST_BYTES = 4
FILTER_BITS = 1 << 24  # 2 MB
BLOCK_BYTES = 8 << 20  # of texts whose terms are counted together
HELD_ROWS = 1_000_000  # that a task sums before it hands them on
TILE = 256
ROWS = 1024  # terms compared at once
BUCKETS = 32  # parts of a language's terms


BLOCKS = "terms binary, langs array<string>, sources array<string>, `group` binary, upto binary, ids binary, sum_group binary, sum_term binary, sum_n binary"


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of documents: its distinct ``terms`` between blanks, the ``langs`` and ``sources`` of its groups; of each document
    its ``group``, where its terms begin (``upto``) and their places among the block's (``ids``); and of each group its terms and their
    occurrences. Numbers are bytes, so that only Python takes them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BLOCK_BYTES) if batch.num_rows else ():
                terms: defaultdict[bytes, int] = defaultdict()
                terms.default_factory = terms.__len__  # a new term takes the next number
                groups, ids, counts, upto = {}, array("i"), array("q"), [0]
                for text in part.column("text"):
                    own = Counter(text.as_py().translate(AS_TERMS).split())
                    ids.extend(map(terms.__getitem__, own))
                    counts.extend(own.values())
                    upto.append(len(ids))
                group = [groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())]
                langs, sources = zip(*groups)
                p = max(1, len(terms))
                keys = np.repeat(np.array(group, np.int64), np.diff(upto)) * p + np.asarray(ids)
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.diff(keys[order], prepend=-1))
                sums = np.add.reduceat(np.asarray(counts)[order], first) if len(first) else np.empty(0, np.int64)
                of_group, of_term = np.divmod(keys[order][first], p)
                numbers = [np.array(group, np.int32), np.array(upto, np.int32), np.asarray(ids, np.int32), of_group.astype(np.int32), of_term.astype(np.int32), sums.astype(np.int64)]
                columns = [pa.array([b" ".join(terms)]), pa.array([langs], pa.list_(pa.string())), pa.array([sources], pa.list_(pa.string())), *(pa.array([x.tobytes()]) for x in numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["terms", "langs", "sources", "group", "upto", "ids", "sum_group", "sum_term", "sum_n"])

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCKS)


def slot(lang: str, prefix: bytes) -> int:
    """The bit of a prefix in the filter."""
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + prefix) % FILTER_BITS


def counted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below ``size`` in order, and how often each occurs."""
    if size > 8 * len(keys) + 1_000_000:
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=size)
    at = np.flatnonzero(n)
    return at, n[at]


class Block:
    """One row of ``blocks``; of its documents the terms that are longer than ``low`` bytes and whose prefix of ``low`` bytes
    passes the filter ``bits`` for the document's language."""

    def __init__(self, batch: pa.RecordBatch, r: int):
        numbers = lambda c, kind=np.int32: np.frombuffer(batch.column(c)[r].as_buffer(), kind)
        joined = batch.column("terms")[r].as_py()
        self.terms = pa.array(joined.split(b" ") if joined else [], pa.binary())
        self.langs, self.sources = batch.column("langs")[r].values, batch.column("sources")[r].values
        has = batch.schema.names
        if "ids" in has:
            self.group, self.upto, self.ids = numbers("group"), numbers("upto"), numbers("ids")
        if "sum_n" in has:
            self.sums = numbers("sum_group"), numbers("sum_term"), numbers("sum_n", np.int64)
        self.size = pc.binary_length(self.terms).to_numpy()
        coded = self.langs.dictionary_encode()
        self.names, self.lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)  # of each group

    def passes(self, lang: np.ndarray, ids: np.ndarray, wanted: np.ndarray, size: int | None, bits: np.ndarray) -> np.ndarray:
        """Which of the terms ``ids`` of languages ``lang`` pass the filter by their prefix of ``size`` bytes."""
        short, place = self.cut(wanted, size)
        p, names, prefixes = max(1, len(short)), self.names.to_pylist(), short.to_pylist()
        keys = lang * p + place[ids]
        pairs, _ = counted(keys, len(names) * p)
        at = np.fromiter((slot(names[x // p], prefixes[x % p]) for x in pairs.tolist()), np.int64, len(pairs))
        return (bits[at >> 3] >> (at & 7) & 1).astype(bool)[np.searchsorted(pairs, keys)] if len(pairs) else np.zeros(0, bool)

    def cut(self, wanted: np.ndarray, size: int | None) -> tuple[pa.Array, np.ndarray]:
        """The distinct prefixes of the wanted terms, and of each term the place of its own."""
        own = self.terms.filter(pa.array(wanted))
        coded = (pc.binary_slice(own, 0, size) if size else own).dictionary_encode()
        place = np.zeros(len(self.terms), np.int64)
        place[wanted] = coded.indices.to_numpy()
        return coded.dictionary, place

    def documents(self, low: int, high: int, bits: np.ndarray | None) -> list[pa.Array]:
        """``lang, prefix, complete, docs``: of each language the prefixes of ``high`` bytes, and the terms that are no longer (true), with
        their number of documents."""
        doc, ids = np.repeat(np.arange(len(self.group)), np.diff(self.upto)), self.ids
        if low:
            kept = self.size[ids] > low
            doc, ids = doc[kept], ids[kept]
        lang = self.lang[self.group]  # of each document
        if bits is not None:
            kept = self.passes(lang[doc], ids, self.size > low, low, bits)
            doc, ids = doc[kept], ids[kept]
        whole = self.size[ids] <= high
        p = max(1, len(self.terms))
        of_term, n_terms = counted(lang[doc[whole]] * p + ids[whole], len(self.names) * p)
        longer = np.zeros(len(self.terms), bool)
        longer[ids[~whole]] = True
        prefixes, place = self.cut(longer, high)
        q = max(1, len(prefixes))
        own, prefix = np.divmod(np.unique(doc[~whole] * q + place[ids[~whole]]), q)
        of_cut, n_cut = counted(lang[own] * q + prefix, len(self.names) * q)
        langs = np.concatenate([of_term // p, of_cut // q])
        text = pa.concat_arrays([self.terms.take(pa.array(of_term % p)), prefixes.take(pa.array(of_cut % q))])
        return [self.names.take(pa.array(langs)), text, pa.array(np.arange(len(langs)) < len(of_term)), pa.array(np.concatenate([n_terms, n_cut]).astype(np.int64))]

    def occurrences(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The groups, terms and occurrences of the terms that pass the filter as a whole."""
        group, term, n = self.sums
        kept = self.passes(self.lang[group], term, np.ones(len(self.terms), bool), None, bits)
        return group[kept], term[kept], n[kept]


def over_blocks(blocked: DataFrame, columns_of, schema: str) -> DataFrame:
    """What ``columns_of`` gives of each ``Block``, its last column summed over the blocks of a task."""
    names = [f.split()[0] for f in schema.split(", ")]

    def summed(tables: list[pa.Table]) -> pa.Table:
        if len(tables) == 1:
            return tables[0]
        out = pa.concat_tables(tables).group_by(names[:-1], use_threads=False).aggregate([(names[-1], "sum")])
        return out.select([*names[:-1], f"{names[-1]}_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for r in range(batch.num_rows):
                held.append(pa.Table.from_arrays(columns_of(Block(batch, r)), names))
                if sum(t.num_rows for t in held) > HELD_ROWS // 2:
                    held = [summed(held)]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches(100_000)
        if held:
            yield from summed(held).to_batches(100_000)

    return blocked.select("terms", "langs", "sources", "group", "upto", "ids").mapInArrow(run, schema)


def occurrences(blocked: DataFrame, kept) -> DataFrame:
    """``lang, source, prefix, n``: the terms that pass the filter with their occurrences in each source, summed over the blocks of a task
    as numbers of groups and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: defaultdict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__
        groups: dict[tuple[str, str], int] = {}
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            names, words = list(groups), pa.array(list(terms), pa.binary())
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            for i in range(0, len(keys), 100_000):
                group, term = pa.array(keys[i : i + 100_000] >> 32), pa.array(keys[i : i + 100_000] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), words.take(term), pa.array(sums[i : i + 100_000])], ["lang", "source", "prefix", "n"])

        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(batch, r)
                group, term, n = block.occurrences(kept.value)
                own = np.array([groups.setdefault(g, len(groups)) for g in zip(block.langs.to_pylist(), block.sources.to_pylist())], np.int64)
                used = np.flatnonzero(np.bincount(term, minlength=len(block.terms)))
                place = np.zeros(len(block.terms), np.int64)
                place[used] = np.fromiter(map(terms.__getitem__, block.terms.take(pa.array(used)).to_pylist()), np.int64, len(used))
                keys, sums = np.concatenate([keys, own[group] << 32 | place[term]]), np.concatenate([sums, n])
                order = np.argsort(keys, kind="stable")
                keys, sums = keys[order], sums[order]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                keys, sums = keys[first], np.add.reduceat(sums, first) if len(first) else sums
                if len(keys) > HELD_ROWS:
                    yield from rows()
                    terms.clear()
                    groups.clear()
                    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        yield from rows()

    return blocked.select("terms", "langs", "sources", "sum_group", "sum_term", "sum_n").mapInArrow(run, "lang string, source string, prefix binary, n long")


def filter_of(prefixes: DataFrame) -> np.ndarray:
    """The filter of ``lang, prefix``: its words come to the driver, at most ``FILTER_BITS / 64`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            at = np.fromiter((slot(a, b) for a, b in zip(batch.column("lang").to_pylist(), batch.column("prefix").to_pylist())), np.int64, batch.num_rows)
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used].view(np.int64))], ["at", "word"])

    found = prefixes.select("lang", "prefix").mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return words.view(np.uint8)


def kept_terms(blocked: DataFrame, least: int) -> DataFrame:
    """``lang, source, term, n``: the occurrences of every kept term in every source that has it."""
    context, found, low, high, passed = blocked.sparkSession.sparkContext, None, 0, FIRST_BYTES, None
    while True:
        own = lambda block, low=low, high=high, passed=passed: block.documents(low, high, None if passed is None else passed.value)
        sums = over_blocks(blocked, own, "lang string, prefix binary, complete boolean, docs long")
        common = written(sums.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least), f"level{high}")
        whole = common.filter("complete").select("lang", "prefix")
        found = whole if found is None else found.union(whole)
        left = common.filter("not complete")
        if passed is not None:
            passed.unpersist()
        if left.isEmpty():
            break
        passed = context.broadcast(filter_of(left))
        low, high = high, 2 * high
    kept = context.broadcast(filter_of(found))
    # Fewer tasks sum more before they shuffle.
    larger = blocked.coalesce(max(context.defaultParallelism, -(-blocked.rdd.getNumPartitions() // 2)))
    sums = occurrences(larger, kept).groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n")).join(found, ["lang", "prefix"], "left_semi")
    return sums.select("lang", "source", F.col("prefix").cast("string").alias("term"), "n")


def share(n: str, total: str, kept: str) -> Column:
    """The smoothed share of ``n`` in thousand millionths, exact for counts of any size."""
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * ({wide(n)} + 5)) div ({wide(total)} + 5 * {wide(kept)})")


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for places ``a <= b`` of two sources: the sum of |p - q| over all kept terms of the language."""
    tile = F.floor(F.col("no") / TILE).cast("int")
    bases = groups.filter("v > 0").groupBy("lang", tile.alias("tile")).agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "p0"))), lambda x: x["p0"]).alias("base"))
    bases = written(bases, "bases")
    tiles = groups.groupBy("lang").agg(F.max(tile).alias("last"))
    rows = kept.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "p"))).alias("own")).join(tiles, "lang")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("j", F.explode(F.sequence("i", "last")))
    part = lambda at: F.filter("own", lambda x: F.floor(x["no"] / TILE) == F.col(at))
    rows = rows.withColumns({"own_i": part("i"), "own_j": part("j")})
    for at in "ij":
        rows = rows.join(bases.select("lang", F.col("tile").alias(at), F.col("base").alias(f"base_{at}")), ["lang", at])
    field = lambda name, f: F.transform(name, lambda x: x[f])
    rows = rows.select("lang", "i", "j", "base_i", "base_j", *(field(f"own_{at}", f).alias(f"{f}_{at}") for at in "ij" for f in ("no", "p")), F.pmod(F.hash("term"), F.lit(BUCKETS)).alias("bucket"))
    rows = rows.repartition("lang", "i", "j", "bucket").sortWithinPartitions("lang", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def result() -> pa.RecordBatch:
            lang, i, j = now
            a, b = np.nonzero(np.ones(sums.shape, bool))
            columns = [pa.array([lang] * len(a), pa.string()), pa.array((a + i * TILE).astype(np.int32)), pa.array((b + j * TILE).astype(np.int32)), pa.array(sums.ravel())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

        def side(batch: pa.RecordBatch, at: str, first: int, start: int, end: int) -> np.ndarray:
            base = np.array(batch.column(f"base_{at}")[start].as_py(), np.int64)
            dense = np.repeat(base[None], end - start, axis=0)
            nos, p = batch.column(f"no_{at}").slice(start, end - start), batch.column(f"p_{at}").slice(start, end - start)
            row = np.repeat(np.arange(end - start), np.diff(nos.offsets.to_numpy()))
            dense[row, nos.flatten().to_numpy() - first * TILE] = p.flatten().to_numpy()
            return dense

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("lang", "i", "j"))))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and end - start < ROWS and keys[end] == keys[start]:
                    end += 1
                _, i, j = keys[start]
                left, right = side(batch, "i", i, start, end), side(batch, "j", j, start, end)
                if keys[start] != now:
                    if now is not None:
                        yield result()
                    now, sums = keys[start], np.zeros((left.shape[1], right.shape[1]), np.int64)
                for s in range(left.shape[1]):
                    sums[s] += np.abs(left[:, s : s + 1] - right).sum(axis=0)
                start = end
        if now is not None:
            yield result()

    return rows.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).filter("a <= b")


def divergence(docs: DataFrame, *, least: int = 30, ranks: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: of each source of a language how far every other source's
    shares of kept terms are from its own (``pair``), and the terms it has above the language's share (``term``, the first ``ranks``)."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    blocked = written(blocks(named), "terms", "zstd")
    kept = written(kept_terms(blocked, least), "kept")

    everywhere = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = everywhere.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    pairs = blocked.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select(F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct()
    groups = pairs.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({"total": F.coalesce("total", F.lit(0)), "v": F.coalesce("v", F.lit(0)), "no": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1})
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "v"))), "groups")

    own = written(kept.join(groups, ["lang", "source"]).select("lang", "source", "no", "term", "n", share("n", "total", "v").alias("p")), "shares")
    sums = pair_sums(own, groups)
    sides = groups.select("lang", "source", F.col("no").alias("x")).join(groups.select("lang", F.col("source").alias("item"), F.col("no").alias("y")), "lang").filter("x <> y")
    pairs = sides.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    q = everywhere.join(langs, "lang").select("lang", "term", share("lang_n", "lang_total", "v").alias("q"))
    above = own.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).union(above.withColumn("rank", place).filter(F.col("rank") <= ranks))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), o AS (
  SELECT row_no, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM k JOIN l USING (lang)
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN (SELECT lang, v FROM l) USING (lang)
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y USING (lang) LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  WHERE x.source <> y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
