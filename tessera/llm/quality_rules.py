"""Operator 8, quality rules: cross-document line frequency beside simple
counts of the text.

Every line is hashed after folding case and white space, and for each host (the
``source``) the distinct documents with a line are counted. A line goes if more
than ``max(min_docs, min(most_docs, share * documents of the host))`` have it:
a share of a small host, an absolute count in a large one. A document that keeps
less than ``min_left`` of its words is rejected.

Lines are hashed and written as digests, and counted with partial aggregation. If
at most ``few`` lines are above a limit, their digests go to every task and texts
aren't shuffled; else they are joined with the lines by (host, hash), where the
planner may split skewed ones, and the places of removed lines with the texts. Both
ways give the same rows.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own; rows that repeat an id count as one document of a line,
and each is judged by its own text; rows without an id are as many documents as
they have texts; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_SPACE, SPACE, digest, table, text_of, uncovered, words, written

MIN_WORDS = 50


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))


def line_hash(line: Column) -> Column:
    return digest(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def host_of(col: str) -> Column:
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(col)))


def hashed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``host, doc_id, key, other, pos, h, n``: every line with a word, by its hash and
    its number of words. ``key`` tells texts apart, ``other`` does so for rows without an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), host_of(host_col).alias("host"), text_of(text_col).alias("text"))
    rows = rows.withColumn("key", digest(F.col("text")))
    lines = rows.select("host", "doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(NOT_SPACE))
    return lines.select("host", "doc_id", "key", F.when(F.col("doc_id").isNull(), F.col("key")).alias("other"), "pos", line_hash(F.col("line")).alias("h"), F.size(words(F.col("line"))).alias("n"))


def frequent_lines(lines: DataFrame, documents: DataFrame, *, min_docs: int, most_docs: int, share: float) -> DataFrame:
    """``host, h``: the lines above their host's limit; ``documents`` has each host's documents, ``host, docs``."""
    counted = lines.select("host", "h", "doc_id", "other").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.least(F.lit(float(most_docs)), share * F.col("docs")))
    return counted.join(documents, "host").filter(F.col("n") > limit).select("host", "h")


def repeated_words(tokens: str, docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: the words of column ``tokens`` that lie in 3-word
    windows found twice or more in it. Windows are sorted by hash, so equal ones
    are neighbours; texts without any take no sort."""
    n = F.size(tokens)
    at = F.col(tokens)
    docs = docs.withColumn("_grams", F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(at, i), F.get(at, i + 1), F.get(at, i + 2)))))
    docs = docs.withColumn("_twice", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    docs = docs.withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("_sorted")
    near = F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
    docs = docs.withColumn("_starts", F.when(F.col("_twice"), F.sort_array(F.transform(near, lambda x: x["i"]))))
    p = F.col("_starts")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_grams", "_twice", "_sorted", "_starts")


def _with_gone(rows: DataFrame, lines: DataFrame, frequent: DataFrame, are_few: bool) -> DataFrame:
    """Adds ``gone``: the places of a text's lines to be removed, with their numbers of words, or null."""
    if are_few:
        bad = frequent.groupBy("host").agg(F.collect_list("h").alias("bad"))
        own = lambda x, i: F.when(x.rlike(NOT_SPACE) & F.array_contains("bad", line_hash(x)), F.struct(i.alias("pos"), F.size(words(x)).alias("n")))
        found = F.filter(F.transform(F.split("text", "\n"), own), lambda x: x.isNotNull())
        rows = rows.join(F.broadcast(bad), "host", "left").withColumn("gone", F.when(F.col("bad").isNotNull(), found))
        return rows.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone"))).drop("bad", "host", "key")
    gone = lines.join(frequent, ["host", "h"]).groupBy(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), F.col("host").alias("gone_host"))
    gone = written(gone.agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("gone")), "gone")
    # Rows of one id and text may have several hosts: each loses what its own host removes.
    same = rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["key"] == gone["gone_key"]) & (rows["host"] == gone["gone_host"])
    return rows.join(gone, same, "left").drop("host", "key", "gone_id", "gone_key", "gone_host")


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, most_docs: int = 1000, share: float = 0.05, min_left: float = 0.5, few: int = 2000, cleaned: bool = False, carry: bool = False
) -> DataFrame:
    """The counts and the verdict for each row of ``docs``: ``doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words``; with ``cleaned`` also ``text`` without the lines above
    the limits, and with ``carry`` the row itself as ``row``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), host_of(host_col).alias("host"), text_of(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    rows = rows.withColumn("key", digest(F.col("text")))
    lines = written(hashed_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col), "lines")
    documents = rows.select("host", "doc_id", F.when(F.col("doc_id").isNull(), F.col("key")).alias("other")).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    frequent = written(frequent_lines(lines, documents, min_docs=min_docs, most_docs=most_docs, share=share), "frequent")
    rows = _with_gone(rows, lines, frequent, frequent.limit(few + 1).count() <= few)
    rows = rows.withColumn("_words", words(F.col("text"))).withColumn("_lines", lines_of(F.col("text")))
    rows = repeated_words("_words", rows)
    n_words = F.size("_words").cast("long")
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    columns = {
        "n_words": n_words,
        "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_removed_words": removed,
    }
    rows = rows.withColumns(columns).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))
    out = [F.col(c) for c in ("doc_id", *list(columns)[:4], "n_repeat_words", "base_failed", "kept", "n_removed_words", *(["row"] if carry else []))]
    if cleaned:
        places = F.transform("gone", lambda x: x["pos"])
        out.append(F.when(F.col("gone").isNotNull(), F.array_join(uncovered(F.split("text", "\n"), places, 1), "\n")).otherwise(F.col("text")).alias("text"))
    # Through a generator no filter on the verdict moves below the counts, where it would take the arrays' expressions
    # into the functions of their elements and compute them for each element again.
    return rows.select(F.inline(F.array(F.struct(*out))))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'n') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), hl AS (
  SELECT doc_id, host, text, unnest(lines) AS line FROM d
), hk AS (
  SELECT doc_id, host, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k FROM hl
), hosts AS (
  SELECT host, count(DISTINCT coalesce(doc_id::VARCHAR, md5(text))) AS docs FROM d GROUP BY host
), bad AS (
  SELECT host, k FROM hk JOIN hosts USING (host) GROUP BY host, k, docs
  HAVING count(DISTINCT coalesce(doc_id::VARCHAR, md5(text))) > greatest(20, least(1000, 0.05::DOUBLE * docs))
), gone AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM hk JOIN bad USING (host, k) GROUP BY doc_id
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_removed_words >= 0.5::DOUBLE * n_words AS kept, n_removed_words FROM b
"""
