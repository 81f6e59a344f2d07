"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups go, largest first, to the least-loaded shard, through a heap. The scheduler sees size classes only: how many
groups there are of each size, so its input is bounded by parameters, whatever the number of documents. Sizes below
FINE have a class each. Larger ones share one with those of the same leading BITS bits, and count with their class's
mean; what the shards then really hold is counted, and the classes below FINE are scheduled, exactly, on top of it.
A group finds its shard by its rank in its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, running, text_column
from tessera.operators.splits import deal_equal

#: Sizes below which each has a class; leading bits of a larger one's. At most FINE + 64 * 2 ** (BITS - 1) classes.
FINE, BITS = 1 << 14, 9


def longest_first(classes: list[tuple[int, float, int]], loads: list[float]) -> tuple[dict[int, list[int]], list[float]]:
    """(class, size, number of groups) -> how many each shard gets of each class, and the loads in the end."""
    dealt = {}
    for name, size, n in sorted(classes, key=lambda c: (-c[1], c[0])):
        dealt[name], loads = deal_equal(loads, size, n)
    return dealt, loads


def _class(size: Column) -> Column:
    drop = F.when(size < FINE, 0).otherwise(F.greatest(F.lit(0), F.length(F.bin(size)) - BITS))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, text_crc32, group_key, shard, slot) of every row.

    size: UTF-8 bytes of the text (null: none) plus ``overhead``; shard sizes come near equal. Rows with equal
    texts (a null text equals an empty one) share group_key and shard. slot: 0, 1, ... in each shard without gaps,
    by doc_id (nulls first), then group; repeated rows take any of their slots. Empty table: empty result. Other
    columns are ignored.
    """
    spark, text = docs.sparkSession, text_column(docs)
    raw = text.cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group_key"))
    rows = materialize(rows, "rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes")).withColumn("class", _class(F.col("bytes")))
    groups = materialize(running(groups, F.lit(1), ["group_key"], ["class"], "groups"), "ranked")
    classes = groups.groupBy("class").agg((F.sum("bytes") / F.count(F.lit(1))).alias("size"), F.count(F.lit(1)).alias("n")).collect()  # bounded by FINE and BITS

    def placed(some: DataFrame, dealt: dict[int, list[int]]) -> DataFrame:
        """``some`` groups with their shard: the first that has not yet been given its share of the class."""
        upto = [(c, [sum(given[: k + 1]) for k in range(shards)]) for c, given in dealt.items()]
        table = spark.createDataFrame(upto, "known long, upto array<long>")
        some = some.join(F.broadcast(table), F.col("class") == F.col("known"))
        return some.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("before")))).select("group_key", "bytes", "shard")

    coarse, _ = longest_first([(r["class"], r["size"], r["n"]) for r in classes if r["class"] >= FINE], [0] * shards)
    large = materialize(placed(groups.where(F.col("class") >= FINE), coarse), "large")
    held = {r["shard"]: r["bytes"] for r in large.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
    fine, _ = longest_first([(r["class"], r["class"], r["n"]) for r in classes if r["class"] < FINE], [held.get(k, 0) for k in range(shards)])
    # Written, so that the join below has two exchanges and the copies of a hot text can be split.
    where = materialize(large.unionByName(placed(groups.where(F.col("class") < FINE), fine)).select(F.col("group_key").alias("g"), "shard"), "placed")
    rows = rows.join(where, F.col("group_key") == F.col("g")).drop("g")
    return running(rows, F.lit(1), ["doc_id", "group_key"], ["shard"], "slots").select("doc_id", "size", "text_crc32", "group_key", "shard", F.col("before").cast("long").alias("slot"))
