"""Connected components by alternating large-star and small-star steps, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, any order, repeats and loops allowed, no nulls -> (node, label), label the smallest node reached.

    An empty table gives an empty table. A node with very many links is never gathered: each step takes a
    minimum (combined before the shuffle) and joins it back, and Spark may split a hot side of that join.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written, so that the joins have two exchanges and a hot node's links can be split.
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # Each link now points from a larger node to a smaller one.
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(small.where("u <> v").distinct(), "links")
        discard(now, least, large, lower)
        now = after
    out = materialize(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
    discard(now)
    return out
