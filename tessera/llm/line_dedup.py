"""Operator 1, line dedup: windows of three consecutive lines are hashed, the
hashes that occur again anywhere are found, and the lines that a later
occurrence covers are removed.

Occurrences are in the order of id, text digest and line number, rows without
an id last; all but the first are later ones. Lines are compared without white
space at their ends; a window of blank lines only is no window. Covered
positions of overlapping windows are merged before lines go.

Texts are read twice, once for the windows and once to drop lines, where they are
shuffled once by id and digest. Windows are
written once, as digests; they are counted with partial aggregation, so one
window in a third of the documents costs one row a task, and the join back is on
the hash, which the planner may split where it is skewed. Lines are cut out
between merged windows, in time linear in the lines of a text.

Defined cases: a null text has no lines; texts of under three lines have no
window and stay; rows that repeat an id are told apart by their texts, and those
that repeat id and text are one document, of which all rows lose the same lines;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import digest, table, text_of, uncovered, written

SPAN = 3


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` for each row of ``docs``; ``text``
    holds the lines that stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text_of(text_col)).alias("key"), F.split(text_col, "\n").alias("lines"))
    trimmed = F.transform("lines", lambda x: F.regexp_replace(x, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""))
    keyed = rows.select("doc_id", "key", trimmed.alias("t")).filter(F.size("t") >= span)
    window = lambda i: F.array_join(F.slice("t", i + 1, span), "\n")
    spans = F.transform(F.sequence(F.lit(0), F.size("t") - span), lambda i: F.when(F.length(window(i)) >= span, digest(window(i))))
    windows = written(keyed.select("doc_id", "key", F.posexplode(spans).alias("pos", "h")).filter("h is not null"), "windows")
    # The first occurrence: by document, then over documents.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "pos")
    seen = windows.groupBy("h", "doc_id", "key").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    again = seen.groupBy("h").agg(F.min(place).alias("first"), F.sum("n").alias("n")).filter("n > 1").select("h", "first")
    again = written(again, "again")
    later = windows.join(again, "h").filter(place > F.col("first"))
    gone = written(later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "gone")
    # Its size grows with the corpus, so it is joined by shuffle at any size.
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "starts").hint("merge")
    found = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["key"] == gone["gone_key"]), "left")
    stays = F.when(F.col("starts").isNull(), F.col("lines")).otherwise(uncovered(F.col("lines"), F.col("starts"), span))
    found = found.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), stays.alias("stays"))
    return found.select("doc_id", "n_lines", F.coalesce(F.col("n_lines") - F.size("stays"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("stays", "\n").alias("text"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS key, string_split(text, chr(10)) AS lines FROM documents
), t AS (
  SELECT DISTINCT doc_id, key, list_transform(lines, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS t FROM d
), w AS (
  SELECT doc_id, key, i, t[i] || chr(10) || t[i + 1] || chr(10) || t[i + 2] AS h
  FROM (SELECT doc_id, key, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 3)
  WHERE length(t[i]) + length(t[i + 1]) + length(t[i + 2]) > 0
), r AS (
  SELECT doc_id, key, i, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, key, i) AS n FROM w
), g AS (
  SELECT doc_id, key, list(DISTINCT p) AS gone FROM (SELECT doc_id, key, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id, key
)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(list_filter(lines, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), 'string_agg', chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.key = g.key
"""
