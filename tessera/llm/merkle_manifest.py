"""Operator 11, Merkle dataset manifest by cogrouped subtree exchange.

Every row becomes a leaf, the leaves of a language a tree by id, and the trees' roots one more
tree. Only digests leave the scan of the texts. Leaves get their places from a
range partitioning and counts of its parts; superblocks of ``2**LEVELS`` leaves at aligned places
are then reduced to one node each, and so are superblocks of those nodes, tier by tier, until a tree
has one node. On the way down, each tier's nodes and the nodes required from outside their superblock are
cogrouped by superblock in ``applyInPandas``: the first tier finishes the local
reduction, joins the proofs and folds them in one step.

A group holds at most ``2**LEVELS`` rows, whatever the size of a language or the number of
rows with one id, and the outer nodes are one row for each superblock.

Defined cases: nulls have an encoding of their own, in any column; a row without an id comes first in its
language and isn't tampered with; rows that repeat an id are leaves each, by their digests; equal
rows are equal leaves at neighbouring places; an empty text is a value; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10  # of a superblock, which so has 1024 nodes at most


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes' count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, part: int) -> DataFrame:
    """``doc_id, lang, leaf, tampered``: the last is the digest with 1 added to ``n_chars`` where
    ``part`` divides the id's checksum, else null."""

    def of(**changed: Column) -> Column:
        return F.sha2(F.concat(*(encoded(changed.get(c, F.col(c))) for c in FIELDS)), 256)

    hit = (F.crc32(F.col("doc_id").cast("string")) % part == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("place"), "lang", of().alias("leaf"), F.when(hit, of(n_chars=more)).alias("tampered"))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in their tree, by ``order`` with nulls first, and the tree's size ``n``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part int, own long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, next_ = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            own = []
            for t in batch.column(tree).to_pylist():
                last, next_ = t, next_ + 1 if t == last else 1
                own.append(next_ - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())], [*batch.schema.names, "part", "own"])

    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    ranked = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "ranked")
    sizes = ranked.groupBy(F.col(tree).alias("t"), F.col("part").alias("p")).agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("t")
    sizes = sizes.withColumns({"before": F.sum("rows").over(whole.orderBy("p")) - F.col("rows"), "n": F.sum("rows").over(whole)}).drop("rows")
    out = ranked.join(sizes, F.col(tree).eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return out.withColumn("pos", F.col("before") + F.col("own")).drop("part", "own", "t", "p", "before")


def local_levels(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The nodes of a superblock of a tree of ``n`` nodes, level by level up to its one node."""
    out = [nodes]
    for _ in range(min(height, (n - 1).bit_length())):
        now = out[-1]
        out.append([digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def local_path(levels: list[list[str]], i: int) -> list[str]:
    """The siblings of place ``i`` up to the superblock's node: each with its side, or ``-`` for none."""
    path = []
    for row in levels[:-1]:
        path.append("L" + row[i - 1] if i & 1 else "R" + row[i + 1] if i + 1 < len(row) else "-")
        i >>= 1
    return path


def exchanged(rows: pd.DataFrame, outer: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """The rows of a superblock by place, and the path of each: within the superblock, then by its outer nodes."""
    rows = rows.sort_values("pos")
    levels, rest = local_levels(list(rows["node"]), int(rows["n"].iloc[0]), height), list(outer["path"].iloc[0])
    return rows, [local_path(levels, i) + rest for i in range(len(rows))]


def folded(node: str, path: list[str]) -> str:
    for step in path:
        node = digest(step[1:], node) if step[0] == "L" else digest(node, step[1:])
    return node


def by_block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def above(nodes: DataFrame, height: int) -> DataFrame:
    """``tree, block, path, root`` for each superblock of ``tree, pos, n, node``: its outer nodes up to its tree's root."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos"), int(rows["n"].iloc[0])
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "pos": rows["block"].iloc[:1], "n": -(-n // (1 << height)), "node": local_levels(list(rows["node"]), n, height)[-1]})

    def join(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, paths = exchanged(rows, outer, height)
        return pd.DataFrame({"tree": rows["tree"], "block": rows["pos"], "path": paths, "root": outer["root"].iloc[0]})

    blocks = by_block(nodes, height).groupBy("tree", "block").applyInPandas(reduce, "tree long, pos long, n long, node string")
    blocks = written(blocks, "blocks")
    if blocks.filter("n > 1").isEmpty():
        return blocks.select("tree", F.col("pos").alias("block"), F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    outer = above(blocks, height)
    return written(by_block(blocks, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(join, "tree long, block long, path array<string>, root string"), "outer")


def manifest(docs: DataFrame, *, part: int = 7, height: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``."""

    def finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, paths = exchanged(rows, outer, height)
        out = rows[["doc_id"]].assign(leaf=rows["node"], subroot=outer["subroot"].iloc[0], root=outer["root"].iloc[0], proof_sha256=[digest(*(s[1:] for s in p)) for p in paths])
        out["folded_root"] = [folded(t or node, p) for node, t, p in zip(rows["node"], rows["tampered"].where(rows["tampered"].notna(), None), paths)]
        return out.assign(verified=out["folded_root"] == out["root"])

    own = placed(leaves(docs, part), "lang", ["place", "leaf"])
    langs = written(own.select("lang").distinct(), "langs").withColumn("all", F.lit(0).cast("long"))
    langs = written(placed(langs, "all", ["lang"]).select(F.col("lang").alias("named"), F.col("pos").alias("tree"), F.col("n").alias("langs")), "trees")
    nodes = own.join(langs, F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "tree", "pos", "n", F.col("leaf").alias("node"), "tampered")
    nodes = written(nodes, "nodes")

    outer = above(nodes.select("tree", "pos", "n", "node"), height)
    subroots = outer.groupBy("tree").agg(F.min("root").alias("node")).join(langs, "tree")
    subroots = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("langs").alias("n"), "node"), "subroots")

    def top(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, paths = exchanged(rows, outer, height)
        return pd.DataFrame({"tree": rows["pos"], "rest": paths, "top": outer["root"].iloc[0]})

    tops = by_block(subroots, height).groupBy("tree", "block").cogroup(above(subroots, height).groupBy("tree", "block")).applyInPandas(top, "tree long, rest array<string>, top string")
    outer = outer.join(written(tops, "tops"), "tree").select("tree", "block", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = by_block(nodes, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_no, doc_id, lang,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS chars,
         coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR, '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM documents
), l AS (
  SELECT row_no, doc_id, lang, sha256(head || chars || tail) AS leaf, sha256(head || CASE WHEN crc % 7 = 0 THEN more ELSE chars END || tail) AS given FROM d
), p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM t WHERE len(nodes) > 1
), s AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1
), u AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM u WHERE len(nodes) > 1
), path AS MATERIALIZED (
  SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY upper, level) AS step, left_side, sibling FROM (
    SELECT row_no, 0 AS upper, level, (pos >> level) & 1 = 1 AS left_side, nodes[xor(pos >> level, 1) + 1] AS sibling FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang WHERE len(nodes) > 1
    UNION ALL SELECT row_no, 1, level, (place >> level) & 1 = 1, nodes[xor(place >> level, 1) + 1] FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, u WHERE len(nodes) > 1)
), f AS (
  SELECT row_no, 0::BIGINT AS step, given AS node FROM p
  UNION ALL SELECT f.row_no, path.step, sha256(CASE WHEN left_side THEN sibling || node ELSE node || coalesce(sibling, '') END) FROM f JOIN path ON path.row_no = f.row_no AND path.step = f.step + 1
), e AS (
  SELECT row_no, max_by(node, step) AS folded_root FROM f GROUP BY row_no
), q AS (
  SELECT row_no, string_agg(sibling, '' ORDER BY step) AS siblings FROM path GROUP BY row_no
)
SELECT doc_id, leaf, subroot, u.nodes[1] AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = u.nodes[1] AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN e USING (row_no) LEFT JOIN q USING (row_no), u WHERE len(u.nodes) = 1
"""
