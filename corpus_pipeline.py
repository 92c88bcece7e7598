"""The corpus pipeline: five stages over ``documents``.

Each stage takes all rows its predecessor kept, and its decisions take effect:
documents that the quality rules reject go, and so do the lines above the
limits; of equal texts and of near copies one document stays; the mix repeats
or leaves out documents; the last stage returns the pieces of the packed
sequences. Each stage's rows are written as Parquet and read again, so a stage
starts from files and a lost executor costs no earlier stage.

The rules and the mix carry the rows, so no verdict is joined with texts there. The
deduplicating stages write only what goes: exact dedup joins it by id and text
with one shuffle of the rows, whatever its size; near-dedup by id, where the planner
broadcasts what goes as long as it is below its threshold. Rows without an id are
never dealt by it alone.

Rows that repeat an id share a verdict: the most lenient of theirs. Exact dedup
judges each by its text, and keeps one row of each text, so copies with one id or
without ids go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, minhash, mixing, packing, quality_rules
from tessera.llm.common import table, written


def _row(docs: DataFrame, name: str = "row") -> list:
    return [F.col(f"{name}.`{c}`") for c in docs.columns]


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(docs, cleaned=True, carry=True)
    fields = []
    for name in docs.columns:
        field = F.col(f"row.`{name}`")
        changed = F.col("row.text").isNotNull() & (F.col("n_removed_words") > 0)
        fields.append(F.when(changed, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}[name]).otherwise(field).alias(name) if name in ("text", "n_chars") else field.alias(name))
    return judged.filter("kept").select(*fields)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.unhex(F.sha2(exact_dedup.normalised(docs["text"]), 256)).alias("sha"))
    verdict = exact_dedup.exact_dedup(docs)
    again = verdict.groupBy("doc_id", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    again = written(again.filter("not kept or n > 1"), "again")
    gone = again.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    kept = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["sha"] == gone["gone_sha"]), "left_anti")
    several = again.filter("kept").select("sha")
    if several.isEmpty():
        return kept.select(*_row(docs))
    # Rows that repeat an id, or lack one, share the verdict that keeps them: one row of each text stays, whichever
    # way the rows lie. Copies fall together before they are shuffled.
    first = F.min_by("row", F.struct("doc_id", "row.text", F.to_json("row"))).alias("row")
    once = kept.join(several, "sha", "left_semi").groupBy("sha").agg(first).select(*_row(docs))
    return kept.join(several, "sha", "left_anti").select(*_row(docs)).union(once)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = minhash.near_dedup(docs, width=5, percent=80).filter("doc_id is not null")
    gone = written(verdict.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id"), "gone")
    # A row without an id has no class and stays.
    return docs.filter("doc_id is null").union(docs.filter("doc_id is not null").join(gone.withColumnRenamed("doc_id", "gone_id"), F.col("doc_id") == F.col("gone_id"), "left_anti"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(docs, carry=True).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return chosen.select(*_row(docs))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Near copies by MinHash and packing by BM25 have no SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
