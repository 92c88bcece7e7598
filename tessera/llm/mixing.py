"""Operator 7, mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Its documents are all taken
``floor(target / words)`` times (the certain whole copies); the words that
remain are sampled without replacement. A document's inclusion probability goes
with the square root of its size, at most 1, scaled so that the expected words
of a source are its remainder: documents of probability 1 are certain, and the
scale is solved exactly over the source's sizes. Documents are ranked by their
random odds ``u / (1 - u)`` over their inclusion odds ``p / (1 - p)``, and the
ranking is cut where its words come nearest to the remainder.

The cut needs no sort of a whole source: ranks lie in (0, 1) and are counted in
``bins`` bins for each source with partial aggregation, then the crossing bin
in as many again, and only what lies in that bin of a bin is sorted. Random
numbers are digests of the id and a seed, so reruns agree. Texts aren't shuffled:
with ``carry`` the rows get their copies from tables of a row for each source, and
of the few documents in the last bin.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source
is a source, in the last place; rows that repeat an id are sampled one by one,
or with ``carry`` those of one id, source and size alike; ties in rank go by id;
an empty table gives an empty result. Further columns are ignored. One row for
each source passes through a single sort, and each source's distinct sizes
through one of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, table, text_of, words, written

MOST = 3  # times a source's or a document's own size


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = MOST) -> DataFrame:
    """``key, source_size, n, target`` from ``key, source_size, n``: shares by
    weight, none above ``most`` times its source, the excess shared again.

    With sources in the order of cap over weight, the capped ones come first, so
    running sums give the common rate of the others.
    """
    w = Window.orderBy("key")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The rate if exactly the sources before this one are capped.
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rated = ranked.withColumn("rate", rate).withColumn("free", F.col("cap") >= F.col("rate") * F.col("weight"))
    # The first source that stays below its cap fixes the rate for all that follow.
    common = F.first(F.when(F.col("free"), F.col("rate")), ignorenulls=True).over(everything)
    return rated.select("key", "source_size", "n", F.coalesce(F.least(F.col("cap").cast("double"), common * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def inclusion_scales(sizes: DataFrame) -> DataFrame:
    """``key, scale`` from ``key, size, n, rest``: the factor of the square root of
    the size for which the probabilities, at most 1, give ``rest`` words. If all
    sizes above one are certain, the others share what is left; the greatest size
    whose probability then stays within 1 is the last that isn't certain."""
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    certain = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("size") * F.sqrt("size") * F.col("n")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rated = sizes.withColumn("scale", (F.col("rest") - certain) / others).filter(F.col("scale") * F.sqrt("size") <= 1)
    return rated.groupBy("key").agg(F.max_by("scale", "size").alias("scale"))


def mix(
    docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = MOST, seed: int = 7, bins: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for each row of ``docs``,
    with ``carry`` also the row itself as ``row``."""
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.size(words(text_of(text_col))).cast("long").alias("size"), *([F.struct("*").alias("row")] if carry else []))
    sized = written(rows.drop("row"), "sized")
    targets = source_targets(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.least(F.floor(share), F.lit(most)).cast("long"))
    targets = targets.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    sampled = targets.filter("rest > 0 AND rest < source_size").select("key", "rest")
    scales = inclusion_scales(sized.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")).join(sampled, "key"))
    targets = written(targets.join(scales, "key", "left"), "targets")

    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    p = F.least(F.col("scale") * F.sqrt("size"), F.lit(1.0))
    ratio = u / (F.lit(1.0) - u) * (F.lit(1.0) - p) / p
    at = F.floor(F.col("rank") * bins)

    def ranked(rows: DataFrame) -> DataFrame:
        out = rows.join(targets, "key").withColumn("_ratio", F.when(F.col("size") > 0, ratio)).withColumn("rank", F.col("_ratio") / (F.col("_ratio") + 1.0)).drop("_ratio")
        return out.withColumn("bin", F.least(at, F.lit(bins - 1))).withColumn("sub", F.floor((F.col("rank") * bins - F.col("bin")) * bins))

    def crossing(counted: DataFrame, by: str, start: Column) -> DataFrame:
        """For each source the first bin in which the words reach the remainder."""
        run = Window.partitionBy("key").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        total = counted.withColumn("upto", start + F.sum("bin_size").over(run)).filter("upto >= rest")
        return total.groupBy("key").agg(F.min(by).alias(f"cut_{by}"), F.min(F.col("upto") - F.col("bin_size")).alias(f"before_{by}"))

    narrow = ranked(sized)
    first = crossing(narrow.filter("rank is not null").groupBy("key", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest")), "bin", F.lit(0))
    inside = narrow.filter("rank is not null").join(first, "key").filter("bin = cut_bin")
    second = crossing(inside.groupBy("key", "sub").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"), F.first("before_bin").alias("start")), "sub", F.col("start"))
    cuts = written(first.join(second, "key", "left"), "cuts")

    on_edge = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("sub") == F.col("cut_sub")), F.lit(False))
    below = F.coalesce((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("sub") < F.col("cut_sub"))), F.lit(False))
    edge = Window.partitionBy("key").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col("before_sub") + F.coalesce(F.sum("size").over(edge), F.lit(0))
    nearer = F.coalesce(passed + F.col("size") / 2.0 < F.col("rest"), F.lit(False)).cast("long")
    last = narrow.join(cuts, "key", "left").filter(on_edge).withColumn("extra", nearer)
    columns = ["doc_id", "size", "source_size", "target", "whole", "extra", *(["row"] if carry else [])]
    if carry:
        same = written(last.groupBy(F.col("doc_id").alias("e_id"), F.col("key").alias("e_key"), F.col("size").alias("e_size")).agg(F.max("extra").alias("e_extra")), "edge")
        decided = ranked(rows).join(cuts, "key", "left")
        decided = decided.join(same, decided["doc_id"].eqNullSafe(same["e_id"]) & (decided["key"] == same["e_key"]) & (decided["size"] == same["e_size"]), "left")
        out = decided.withColumn("extra", F.coalesce("e_extra", below.cast("long"))).select(*columns)
    else:
        easy = narrow.join(cuts, "key", "left").filter(~on_edge).withColumn("extra", below.cast("long"))
        out = easy.select(*columns).unionByName(last.select(*columns))
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT key, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY key
), w AS (
  SELECT *, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s
), r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS rate
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT arg_min(rate, (cap::DOUBLE / weight, key)) AS common FROM r WHERE cap >= rate * weight
), t AS (
  SELECT key, source_size, n, coalesce(least(cap::DOUBLE, common * weight), cap::DOUBLE) AS target FROM r, c
), p AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END), 3)::BIGINT AS whole FROM t
), q AS (
  SELECT *, greatest(target - whole * source_size, 0.0::DOUBLE) AS rest FROM p
), z AS (
  SELECT key, size, count(*) AS n, any_value(rest) AS rest FROM sized JOIN q USING (key) WHERE size > 0 AND rest > 0 AND rest < source_size GROUP BY key, size
), y AS (
  SELECT key, size, (rest - coalesce(sum(size * n) OVER (PARTITION BY key ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(size * sqrt(size::DOUBLE) * n) OVER (PARTITION BY key ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM z
), x AS (
  SELECT key, arg_max(scale, size) AS scale FROM y WHERE scale * sqrt(size::DOUBLE) <= 1 GROUP BY key
), u AS (
  SELECT sized.doc_id, sized.size, q.*, least(scale * sqrt(sized.size::DOUBLE), 1.0::DOUBLE) AS p,
         (('0x' || substr(md5('7:' || coalesce(sized.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN q USING (key) LEFT JOIN x USING (key)
), k AS (
  SELECT *, CASE WHEN size > 0 THEN u / (1.0::DOUBLE - u) * (1.0::DOUBLE - p) / p END AS ratio FROM u
), f AS (
  SELECT *, ratio / (ratio + 1.0::DOUBLE) AS rank FROM k
), g AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM f WHERE rank IS NOT NULL
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN passed + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM g
UNION ALL
SELECT doc_id, size, source_size, target, (whole * size)::BIGINT AS taken FROM f WHERE rank IS NULL
"""
