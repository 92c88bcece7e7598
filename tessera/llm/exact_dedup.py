"""Operator 9, exact dedup: group by a 128-bit content hash, keep the smallest
id, and compare bytes inside the groups so that a collision merges nothing.

Only digests are shuffled to form the groups. The texts of groups with two or
more members are moved once, by id and hash, and each group is reduced to its
least and greatest text with partial aggregation, so a group of any size is
spread over all tasks. Where both are the same bytes, the whole group is; where
they aren't, that hash's texts are grouped by their bytes.

Defined cases: a null text counts as empty; empty texts form one group; an
empty table gives an empty result; rows that repeat an id are judged by their
texts, each counted, and those that repeat a text with the group's least id are
all kept; a row with a null id joins its group, and is kept only if no member
has an id. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, digest, table, text_of, written


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_of=digest) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, sha256`` for every row of ``docs``.

    ``hash_of`` maps the normalised text to the grouping hash; tests pass a
    weak one to see collisions told apart.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    hashed = written(rows.select("doc_id", hash_of(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "hashed")
    groups = written(hashed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1"), "groups")
    found = hashed.join(groups, "h", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "sha", F.col("n").isNotNull().alias("shared"), "h"
    )
    # Compare bytes: one text shuffle, then a reduction that combines before it shuffles. Rows without an id have no
    # key to be dealt by and are reduced where they lie.
    texts = rows.select("doc_id", hash_of(F.col("norm")).alias("h"), "norm")
    members = found.filter("shared and doc_id is not null").select("doc_id", "h").distinct()
    compared = texts.join(members, ["doc_id", "h"]).select("h", "norm").union(texts.filter("doc_id is null").select("h", "norm"))
    collided = written(compared.groupBy("h").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("h"), "collided")
    if not collided.isEmpty():
        own = texts.join(collided, "h").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_true"), F.count("*").alias("n_true"))
        own = own.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_true", "n_true")
        found = found.join(own, ["h", "sha"], "left").withColumns({"keep_id": F.when(F.col("n_true").isNull(), F.col("keep_id")).otherwise(F.col("keep_true")), "group_size": F.coalesce("n_true", "group_size")})
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
