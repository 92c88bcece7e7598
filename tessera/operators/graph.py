"""Reachability and cycles over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written


def reach(edges: DataFrame, *, source: str = "src", target: str = "dst") -> DataFrame:
    """``src, dst, hops``: every pair joined by a path, with its least number of
    edges. Each round joins only the pairs found last; it ends when none are new,
    however long the paths. What a round finds is written to the shared folder, so
    no round computes an earlier one again. A node that reaches itself lies on a
    cycle."""
    edge = written(edges.selectExpr(f"{source} AS src", f"{target} AS dst").distinct(), "edges")
    step = edge.selectExpr("src AS dst", "dst AS nxt")
    found = last = edge.selectExpr("src", "dst", "1 AS hops")
    hops = 1
    while True:
        hops += 1
        new = last.join(step, "dst").selectExpr("src", "nxt AS dst", f"{hops} AS hops").distinct()
        last = written(new.join(found, ["src", "dst"], "left_anti"), "paths")
        if last.isEmpty():
            return found
        found = found.union(last)


def _trimmed(edge: DataFrame) -> DataFrame:
    """Without the edges from nodes that none leads to, and to nodes that lead nowhere."""
    return edge.join(edge.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edge.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _contracted(edge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Nodes with one edge in and one out are links of chains. Gives the edges with each chain as one edge between its ends; the links ``node, head, tail``
    of such chains; and the links ``node, component`` of chains that are rings. Ends are found by doubling pointers, in as many rounds as
    the longest chain's logarithm."""
    outs = edge.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("tail"))
    ins = edge.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("head"))
    link = written(outs.join(ins, "node").filter("outs = 1 and ins = 1").select("node", "head", "tail", F.col("node").alias("least")), "links")
    count = link.count()
    if not count:
        return None
    pointer = link
    for _ in range(count.bit_length() + 1):
        ahead = pointer.select(F.col("node").alias("tail"), F.col("tail").alias("next"), F.col("least").alias("also"))
        back = pointer.select(F.col("node").alias("head"), F.col("head").alias("previous"))
        step = pointer.join(ahead, "tail", "left").join(back, "head", "left")
        step = written(step.select("node", F.coalesce("previous", "head").alias("head"), F.coalesce("next", "tail").alias("tail"), F.least("least", "also").alias("least"), F.coalesce("next", "previous").isNotNull().alias("moved")), "pointers")
        pointer = step.select("node", "head", "tail", "least")
        if step.filter("moved").isEmpty():
            break
    nodes = link.select(F.col("node").alias("tail"))
    rings = pointer.join(nodes, "tail", "left_semi").select("node", F.col("least").alias("component"))
    chains = pointer.join(nodes, "tail", "left_anti").select("node", "head", "tail")
    outside = edge.join(link.select(F.col("node").alias("src")), "src", "left_anti").join(link.select(F.col("node").alias("dst")), "dst", "left_anti")
    return written(outside.select("src", "dst").union(chains.select("head", "tail")).distinct(), "edges"), chains, rings


def _coloured(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, component`` of the strongly connected components whose greatest node leads to no greater one, and the edges of the
    other nodes: a node's colour is the greatest node that leads to it, and what leads back to that node in its colour is its component."""
    colour = written(edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    while True:
        into = edge.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("other"))
        step = colour.join(into, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", "other").alias("colour"), (F.coalesce("other", "colour") > F.col("colour")).alias("new"))
        step = written(step, "colours")
        colour = step.select("node", "colour")
        if step.filter("new").isEmpty():
            break
    named = edge.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("own")), "dst")
    inside = written(named.filter("colour = own").select("src", "dst"), "inside")
    found = last = written(colour.filter("node = colour"), "roots")
    while True:
        new = inside.join(last.select(F.col("node").alias("dst"), F.col("colour").alias("component")), "dst").select(F.col("src").alias("node"), F.col("component").alias("colour")).distinct()
        last = written(new.join(found, "node", "left_anti"), "members")
        if last.isEmpty():
            break
        found = written(found.union(last), "members")
    rest = edge.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
    return found.select("node", F.col("colour").alias("component")), written(rest.select("src", "dst"), "edges")


def strong_components(edges: DataFrame, *, source: str = "src", target: str = "dst") -> DataFrame:
    """``node, component`` for every node on a cycle: nodes that lead to each other share the least of them.

    Nodes that can't be on a cycle are trimmed and chains contracted, in turn, until neither changes; what is left is
    coloured. No round holds more than the edges and a row for each node, and a path of any length takes the
    logarithm of its length in rounds. Null ends are no nodes."""
    edge = written(edges.selectExpr(f"{source} AS src", f"{target} AS dst").filter("src is not null and dst is not null").distinct(), "edges")
    found = edge.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    levels: list[DataFrame] = []
    size = edge.count()
    while size:
        edge = written(_trimmed(edge), "edges")
        if (step := _contracted(edge)) is not None:
            edge, chains, rings = step
            levels.append(chains)
            found = found.union(rings)
        now = edge.count()
        if now == size:
            break
        size = now
    while not edge.isEmpty():
        loops = edge.filter("src = dst").select(F.col("src").alias("node"))
        members, rest = _coloured(edge)
        several = members.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
        found = found.union(members.join(several, "component", "left_semi").select("node", "component")).union(members.join(loops, "node", "left_semi").join(several, "component", "left_anti").select("node", "component"))
        edge = written(_trimmed(rest), "edges")
    found = written(found, "components")
    for chains in reversed(levels):  # a chain between two nodes of a component is of it
        ends = [found.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("head", "component"), ("tail", "other"))]
        found = written(found.union(chains.join(ends[0], "head").join(ends[1], "tail").filter("component = other").select("node", "component")), "components")
    return found.join(found.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))


def cycles(edges: DataFrame, **names) -> DataFrame:
    """The nodes that lie on a cycle."""
    return strong_components(edges, **names).select(F.col("node").alias("src"))
