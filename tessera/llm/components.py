"""Connected components of a table of links, by least label with pointer jumping.

Each round every node takes the least label of its neighbours, then the label
of its label; rounds end when no label changes, after about the logarithm of the
longest path. Labels are written to the shared folder after each round, so
plans stay short and a lost executor costs one round at most. Only counts come
to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the least node that it reaches."""
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step, "step")
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        step = written(step.join(hop, "label").select("node", "old", F.least("label", "hop").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
