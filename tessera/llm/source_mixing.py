"""Mixing sources to target weights by weighted fair queueing, as DataFrame operations only.

Each source's documents are shuffled by a hash. A document's copy is sent at a virtual time: the tokens that its
source has sent by the copy's middle, divided by the source's target. All copies are globally range-sorted by these
times, so the sources stay in proportion all along, and the queue is cut where the total budget is used up. A copy
at the end is taken if its middle is sent before the budget ends.

Running sums, inside a source and over the queue, are taken inside range partitions and carried over by the
partitions' totals, so neither a hot source nor the queue is one task's work. Tables with a row for each source are
never gathered, so sources may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, packed, running, text_column, unpacked


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; written as positive ranges, which are matched much faster."""
    return F.regexp_count(text, F.lit(r"[\x21-\x{10FFFF}\x00-\x08\x0E-\x1F]+")).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a digest of seed, id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), text).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2) -> DataFrame:
    """(source, size), a row for each source -> (source, no, source_size, target).

    Sources go by code point, null last (no: 0, 1, ...), and weigh ``weights``, repeating. Together they get ``share``
    times all sizes by weight, each at most ``most`` times its own size; what is over a limit is shared again by
    weight among the others. Each sharing is one aggregate over the table.
    """
    ranked = running(sizes, F.lit(1), [F.col("source").isNull(), F.col("source")], [], "sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("before") % len(weights) + 1).cast("int"))
    known = materialize(ranked.select("source", F.col("before").cast("long").alias("no"), F.col("size").alias("source_size"), weight.alias("weight")), "weighed")
    size, limit = F.col("source_size"), F.lit(float(most)) * F.col("source_size")
    total = float(known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    over, left, free = F.lit(False), min(share, most) * total, None
    while True:
        row = known.agg(F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("limits"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if row["free"] == free or not row["free"]:
            break
        free, left = row["free"], min(share, most) * total - row["limits"]
        over = limit < F.lit(left) * F.col("weight") / F.lit(free)
    target = F.when(over, limit).otherwise(F.least(limit, F.lit(left) * F.col("weight") / F.lit(free))) if free else limit
    return known.select("source", "no", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, source, size, source_size, target, copies, taken, finish, start, row_hash) of every row.

    size: words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0). copies: how often the mix takes the row, 0 to ``most``;
    taken: that many times its size. start, finish: virtual times (1: the source's target is sent) between which its
    first copy is sent. The order of a source is a digest of seed, doc_id and text, so reruns agree; rows equal in
    both are taken in any order, with equal results as a set. Null sources are one source; empty texts take no
    words. If all sizes are 0 nothing is taken. An empty table gives an empty table; other columns are ignored.
    """
    text = text_column(docs)
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), shuffle_key(F.col("doc_id"), text, seed).alias("row_hash"))
    base = materialize(base, "sizes")
    known = materialize(source_targets(base.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most), "targets")
    budget = float(known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * min(share, most)
    own = known.withColumnRenamed("source", "known")
    rows = base.join(own, F.col("source").eqNullSafe(F.col("known"))).drop("known")
    sent = materialize(running(rows, F.col("size"), ["row_hash", "doc_id"], ["no"], "sent"), "timed")
    middles = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (F.col("before") + F.col("size") / 2 + e * F.col("source_size")) / F.col("target"))
    some = (F.col("target") > 0) & (F.col("size") > 0)
    queue = running(sent.where(some).select("size", "row_hash", F.explode(middles).alias("time")), F.col("size"), ["time", "row_hash"], [], "queue")
    first = queue.where(F.col("before") + F.col("size") / 2 > F.lit(budget)).orderBy("time", "row_hash").first()  # not taken
    taken = F.lit(True) if first is None else F.lit(False)
    inside = (lambda t: (t < F.lit(first["time"])) | ((t == F.lit(first["time"])) & (F.col("row_hash") < F.lit(first["row_hash"])))) if first else (lambda t: taken)
    copies = F.when(some, F.size(F.filter(middles, inside))).otherwise(0)
    when = lambda x: F.when(F.col("target") > 0, x / F.col("target")).otherwise(0.0)
    return sent.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
        when(F.col("before") + F.col("size")).alias("finish"), when(F.col("before")).alias("start"), "row_hash",
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, queued: bool = False) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``, whatever their names.

    Rows without words take no budget and stay once. ``queued``: range-sorted by the time at which each copy is sent
    (another exchange of the texts); else in any order.
    """
    found = materialize(mix_sources(docs, weights, share, most, seed), "mixed")
    period = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(0.0)
    taken = found.select(F.col("doc_id").alias("mix_id"), F.col("row_hash").alias("mix_hash"), F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).alias("copies"), "start", period.alias("period"))
    taken = taken.groupBy("mix_id", "mix_hash").agg(F.max("copies").alias("copies"), F.min("start").alias("start"), F.min("period").alias("period")).where("copies > 0")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("doc_id"), shuffle_key(F.col("doc_id"), text_column(docs), seed).alias("row_hash"))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("row_hash") == F.col("mix_hash")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    if queued:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("time", F.col("start") + F.col("copy") * F.col("period")).repartitionByRange(parts, "time", "row_hash").sortWithinPartitions("time", "row_hash")
    return rows.select(*unpacked("row", docs.columns))
