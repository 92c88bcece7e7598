"""The log of comparisons is dealt by digest to parts that grow in number with the input."""

import re

from pyspark.sql import functions as F

from tessera.operators import history


def test_parts_grow_with_the_input_and_each_comparison_is_there_once(spark, monkeypatch, tmp_path):
    pairs = spark.range(4000).select(*((F.col("id") % m).cast("string").alias(c) for c, m in (("track_id", 500), ("left_run", 7), ("right_run", 3), ("kind", 2))))
    held = pairs.filter("kind = '0'").distinct().withColumn("comparison_id", F.sha2(F.concat_ws("|", "track_id", "left_run", "right_run", "kind"), 256))
    held.write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    monkeypatch.setattr(history, "PART_BYTES", 1000)
    out = history.stored_comparisons(held, pairs)
    numbers = [int(n) for n in re.findall(r"RepartitionByExpression \[[^]]*\], (\d+)", out._jdf.queryExecution().analyzed().toString())]
    assert len(numbers) == 3 and len(set(numbers)) == 1 and numbers[0] > 20  # the session's shuffles have 4
    ids = [r.comparison_id for r in out.collect()]
    assert len(ids) == len(set(ids)) == pairs.distinct().count()
    assert history.stored_comparisons(out, pairs).count() == len(ids)
