"""Group-aware splits: groups are dealt whole, on a table of group sizes, and joined back."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deal_equal(loads: list[float], size: float, n: int) -> tuple[list[int], list[float]]:
    """How many of n things of one size each bin gets, if each goes to the then least-loaded bin (ties: the first).

    The n least of all loads that bins would have on the way are those taken: all below a level, found by bisection,
    are counted at once, and a heap deals the few that are left. Gives the counts and the loads in the end.
    """
    below = lambda level: [max(0, math.ceil((level - load) / size)) for load in loads]
    low, high = min(loads), max(loads) + size * (n // len(loads) + 1)
    for _ in range(64):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(below(middle)) <= n else (low, middle)
    counts = below(low)
    heap = [(load + c * size, k) for k, (load, c) in enumerate(zip(loads, counts, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        load, k = heapq.heappop(heap)
        counts[k] += 1
        heapq.heappush(heap, (load + size, k))
    return counts, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def _deal(load: list[int], n: int, groups: int) -> list[tuple[int, list[int]]]:
    """Deals groups of n rows, each to the then smallest fold (ties: the first); ``load`` is changed in place.

    Gives (first rank, folds in turn from it on). Folds join one by one as the smaller ones reach their load; between
    two joins the loads are less than n apart, so the turn stays the same.
    """
    joins, active, spans, rank = sorted(range(len(load)), key=lambda f: (load[f], f)), [], [], 0
    for k, f in enumerate(joins):
        active.append(f)
        left = groups - rank
        if not left:
            break
        turn = sorted(active, key=lambda g: (load[g], g))
        if k + 1 < len(joins):
            e = joins[k + 1]
            left = min(left, sum(max(0, (load[e] - load[g] - (g > e)) // n + 1) for g in turn))
        if left:
            spans.append((rank, turn))
        for i, g in enumerate(turn):
            load[g] += n * (left // len(turn) + (i < left % len(turn)))
        rank += left
    return spans


def group_kfold(rows: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, n, fold): largest groups first (ties by seeded hash), each to the then smallest fold.

    Folds differ by the largest group at most. The deal runs over distinct sizes and counts, a short list, not over
    groups; a group finds its fold by its rank among groups of its size.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    runs = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n")).collect()  # distinct sizes
    load = [0] * folds
    plan = [(r["n"], _deal(load, r["n"], r["groups"])) for r in runs]
    table = rows.sparkSession.createDataFrame(plan or [(0, [(0, [0])])], "n long, spans array<struct<low:long,turn:array<int>>>")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(64))
    ranked = sizes.withColumn("b", bucket).withColumn("r", F.row_number().over(Window.partitionBy("n", "b").orderBy(F.xxhash64(F.lit(seed), F.col(group)), group)) - 1)
    starts = ranked.groupBy("n", "b").agg(F.count(F.lit(1)).alias("c")).select("n", "b", (F.sum("c").over(Window.partitionBy("n").orderBy("b")) - F.col("c")).alias("s"))
    ranked = ranked.join(starts, ["n", "b"]).join(F.broadcast(table), "n").withColumn("r", F.col("s") + F.col("r"))
    ranked = ranked.withColumn("span", F.element_at(F.filter("spans", lambda s: s["low"] <= F.col("r")), -1))
    place = (F.col("r") - F.col("span.low")) % F.size("span.turn") + 1
    return ranked.select(group, "n", F.element_at("span.turn", place.cast("int")).alias("fold"))


def train_valid(rows: DataFrame, group: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(group, n, split): by a seeded hash order, groups go to train while half of them still fits the target, the first always.

    The target is the integer part of ``share`` times all rows. A group that does not fit goes to valid and does not
    count. What may still come is then smaller than it, so each round is a running sum over groups that may fit,
    up to the first that does not.
    """
    slots = 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("tv_hash", F.xxhash64(F.lit(seed), F.col(group)))
    sizes = sizes.withColumn("tv_key", F.coalesce(F.col(group).cast("string"), F.lit(""))).withColumn("slot", F.floor((F.col("tv_hash") / F.lit(2.0**64) + 0.5) * slots).cast("int"))
    target = int(share * rows.count())
    inside = Window.partitionBy("slot").orderBy("tv_hash", "tv_key").rowsBetween(Window.unboundedPreceding, 0)
    count, taken, later = 0, F.lit(False), F.lit(True)
    while True:
        fits = later & ((F.col("n") / 2 + count <= target) if count else F.lit(True))
        some = sizes.where(fits)
        before = some.groupBy("slot").agg(F.sum("n").alias("t")).select("slot", (F.sum("t").over(Window.orderBy("slot")) - F.col("t")).alias("b"))  # a row a slot
        upto = some.join(before, "slot").withColumn("upto", F.lit(count) + F.col("b") + F.sum("n").over(inside))
        over = upto.where((F.col("upto") - F.col("n") / 2 > target) & (F.col("upto") > F.col("n"))).orderBy("tv_hash", "tv_key").first()
        if over is None:
            taken = taken | fits
            break
        place = (F.col("tv_hash") < over["tv_hash"]) | ((F.col("tv_hash") == over["tv_hash"]) & (F.col("tv_key") < over["tv_key"]))
        taken, later = taken | (fits & place), later & ~place & ~((F.col("tv_hash") == over["tv_hash"]) & (F.col("tv_key") == over["tv_key"]))
        count = over["upto"] - over["n"]
    return sizes.select(group, "n", F.when(taken, "train").otherwise("valid").alias("split"))


def split_sizes(groups: int, shares: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> tuple[int, int, int]:
    """How many groups train, valid and test get: test the share rounded up, valid its share of what is left rounded up
    (in floating point: of 9 groups left it gets 3); the last group is always train's."""
    test = min(math.ceil(shares[2] * groups), max(0, groups - 1))
    valid = min(math.ceil(shares[1] / (shares[0] + shares[1]) * (groups - test)), max(0, groups - test - 1))
    return groups - test - valid, valid, test


def _least(keyed: DataFrame, order: str, key: str, k: int) -> Column:
    """A condition that holds for the k least rows by (order, key), ``order`` a text of hexadecimal digits.

    Rows are counted by their first four digits (65,536 counts at most); only those of the one count in which the
    border falls are sorted.
    """
    if k <= 0:
        return F.lit(False)
    counts = sorted(keyed.groupBy(F.left(order, F.lit(4)).alias("head")).count().collect())
    before, head, size = 0, "", 0
    for r in counts:
        head, size = r["head"], r["count"]
        if before + size >= k:
            break
        before += size
    else:
        return F.lit(True)
    if before + size == k:
        return F.left(order, F.lit(4)) <= head
    inside = keyed.where(F.left(order, F.lit(4)) == head).select(order, key).orderBy(order, key).limit(k - before)
    last = inside.agg(F.max(F.struct(order, key)).alias("m")).first()["m"]
    return (F.col(order) < last[order]) | ((F.col(order) == last[order]) & (F.col(key) <= last[key]))


def group_split(rows: DataFrame, group: str, shares: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42) -> DataFrame:
    """(group, split): groups dealt to train, valid and test in exactly the numbers of ``split_sizes``.

    Two steps, each with a seeded order of its own: the least groups of the first go to test, the least of the others
    by the second go to valid. Groups go by their text; a null group is left out.
    """
    text = F.col(group).cast("string")
    order = lambda n: F.md5(F.concat(F.lit(f"{n}/"), text).cast("binary"))
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct().select(group, order(seed).alias("gs_first"), order(seed + 1).alias("gs_second"), text.alias("gs_key"))
    _, valid, test = split_sizes(groups.count(), shares)
    tested = _least(groups, "gs_first", "gs_key", test)
    valued = _least(groups.where(~tested), "gs_second", "gs_key", valid)
    return groups.select(group, F.when(tested, "test").when(valued, "valid").otherwise("train").alias("split"))


def leaks(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split, with rows on each side."""
    return rows.groupBy(group).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "valid").alias("valid")).where("train > 0 and valid > 0")
