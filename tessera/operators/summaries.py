"""Summaries of data sets: class shares, fills, skips, clips and crops; ordinals inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import safe_div


def class_distribution(rows: DataFrame, column: str, classes: list) -> DataFrame:
    """(cls, n, ratio) of every class of a list, 0 where it is missing; other values count in no class."""
    counted = rows.where(F.col(column).isin(classes)).groupBy(F.col(column).alias("cls")).agg(F.count(F.lit(1)).alias("found"))
    table = rows.sparkSession.createDataFrame([(c,) for c in classes], counted.select("cls").schema)
    n = F.coalesce("found", F.lit(0))
    out = table.join(counted, "cls", "left").select("cls", n.cast("long").alias("n"))
    return out.select("cls", "n", F.round(safe_div(F.col("n"), F.sum("n").over(Window.partitionBy())), 4).alias("ratio"))


def fill_report(rows: DataFrame, by: str, reason: Column, fields: dict[str, Column]) -> DataFrame:
    """(by, total, filled, rate, top_reason, has_<field>): the commonest reason of failure (ties by name), and how often each field is set."""
    found = rows.select(F.col(by), reason.alias("reason"), *(v.isNotNull().alias(f"has_{k}") for k, v in fields.items()))
    names = [f"has_{k}" for k in fields]
    part = found.groupBy(by, "reason").agg(F.count(F.lit(1)).alias("rows_here"), *(F.count_if(F.col(c)).alias(c) for c in names))
    top = F.min(F.when(F.col("reason") != "", F.struct((-F.col("rows_here")).alias("m"), "reason")))["reason"]
    out = part.groupBy(by).agg(F.sum("rows_here").alias("total"), F.sum(F.when(F.col("reason") == "", F.col("rows_here")).otherwise(0)).alias("filled"), F.coalesce(top, F.lit("")).alias("top_reason"), *(F.sum(c).alias(c) for c in names))
    return out.select(by, "total", "filled", F.round(safe_div(F.col("filled"), F.col("total")), 4).alias("rate"), "top_reason", *names)


def skip_summary(skips: DataFrame, total: int) -> DataFrame:
    """skips (reason, file) -> (category, count, ratio_of_skip, ratio_of_total), TOTAL included.

    A file counts once for each of its reasons, so TOTAL may exceed the number of different files.
    """
    part = skips.distinct().groupBy(F.coalesce("reason", F.lit("_unknown")).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    whole = part.agg(F.lit("TOTAL").alias("category"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))  # a row without any skips too
    both = part.unionByName(whole).withColumn("all", F.max(F.when(F.col("category") == "TOTAL", F.col("count"))).over(Window.partitionBy()))
    return both.select("category", "count", F.round(safe_div(F.col("count"), F.col("all")), 4).alias("ratio_of_skip"), F.round(safe_div(F.col("count"), F.lit(total)), 4).alias("ratio_of_total"))


def drop_skipped(rows: DataFrame, frame: str, cls: str, skip: str) -> tuple[DataFrame, DataFrame]:
    """Rows of other classes (a null class stays), and the frames that have none left."""
    kept = rows.where(F.coalesce(F.col(cls) != skip, F.lit(True)))
    bare = rows.groupBy(frame).agg(F.count_if(F.coalesce(F.col(cls) != skip, F.lit(True))).alias("n")).where("n = 0").select(frame)
    return kept, bare


def clip_summary(rows: DataFrame, file: str, delta: str) -> DataFrame:
    """(files, rows, changed, most, least): least and most over the largest change of each file that has one."""
    per = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("c"), F.max(delta).alias("d"))
    touched = F.when(F.col("d") > 0, F.col("d"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed"), F.max(touched).alias("most"), F.min(touched).alias("least"))


def size_summary(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Least, mean and largest of each column by group."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("avg", F.avg), ("max", F.max))))


def ordinals(rows: DataFrame, keys: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 inside their keys. The keys are a drawing and a class, a small group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def join_by_ordinal(crops: DataFrame, annotations: DataFrame, key: str, cls: str, order: str) -> DataFrame:
    """The n-th crop of a drawing's class with its n-th annotation; crops without one keep nulls.

    Both sides: ``key``, ``cls``, ``order``. Other names must differ.
    """
    a, b = ordinals(crops, [key, cls], [order]), ordinals(annotations, [key, cls], [order]).drop(order)
    return a.join(b, [key, cls, "ordinal"], "left")


def mean_edit_distance(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, distance): mean over the fields that are set on both sides (``p_`` and ``g_`` columns); null without any."""
    each = F.array_compact(F.array(*(F.levenshtein(F.col(f"p_{f}"), F.col(f"g_{f}")) for f in fields)))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return pairs.select(key, F.when(F.size(each) > 0, total / F.size(each)).alias("distance"))


def group_shuffle(rows: DataFrame, group: str, shares: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42) -> DataFrame:
    """(group, split): groups by a seeded hash into train, valid and test, by share of groups.

    The place of a group depends on itself and the seed only, so new groups leave the others where they are.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    split = F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "valid").otherwise("test")
    return rows.select(group).distinct().select(group, split.alias("split"))
