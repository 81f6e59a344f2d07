"""Quality metrics over DataFrames: counts are combined before the shuffle, one grouping gives keys and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import numerical_match
from tessera.functions.text import normalize_text


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """F1 comes from unrounded precision and recall."""
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(safe_div(2 * p * r, p + r), digits).alias("f1")]


def counts(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")]


def by_key_and_overall(rows: DataFrame, key: str, aggregates: list[Column], overall: str = "_all") -> DataFrame:
    """One row for each key and one for all, in one pass. Null keys are ``_unknown``."""
    keyed = rows.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("_unknown")))
    out = keyed.rollup(key).agg(*aggregates, F.grouping(key).alias("grouped"))
    return out.withColumn(key, F.when(F.col("grouped") == 1, overall).otherwise(F.col(key))).drop("grouped")


def confusion_matrix(pairs: DataFrame, actual: str, predicted: str, n: int) -> DataFrame:
    """Dense n x n counts (actual, predicted, n); pairs out of range are dropped."""
    found = pairs.where(F.col(actual).between(0, n - 1) & F.col(predicted).between(0, n - 1)).groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    cells = pairs.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("actual"), (F.col("id") % n).cast("int").alias("predicted"))
    return cells.join(found, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def leaves(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of a row as (key, path, value): nulls and empty strings are absent."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields)))
    return rows.select(key, pairs.alias("leaf")).select(key, "leaf.path", "leaf.value").where("value is not null and value <> ''")


def compare_leaves(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Full outer comparison: (key, path, has_pred, has_gt, hit). Numbers match within tolerance, texts by their normal form."""
    p, g = predicted.select(key, "path", F.col("value").alias("p")), actual.select(key, "path", F.col("value").alias("g"))
    both = p.join(g, [key, "path"], "full_outer")
    a, b = F.col("p").try_cast("double"), F.col("g").try_cast("double")
    same = (normalize_text(F.col("p")) == normalize_text(F.col("g"))) | (a.isNotNull() & b.isNotNull() & numerical_match(a, b))
    return both.select(key, "path", F.col("p").isNotNull().alias("has_pred"), F.col("g").isNotNull().alias("has_gt"), F.coalesce(same, F.lit(False)).alias("hit"))


def field_f1(compared: DataFrame, by: list[str]) -> DataFrame:
    """tp: hits; fp: predicted less hits; fn: actual less hits."""
    tp = F.count_if(F.col("hit"))
    out = compared.groupBy(*by).agg(tp.alias("tp"), (F.count_if(F.col("has_pred")) - tp).alias("fp"), (F.count_if(F.col("has_gt")) - tp).alias("fn"))
    return out.select(*by, "tp", "fp", "fn", *precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def hallucination_rate(compared: DataFrame, allowed: list[str], by: list[str]) -> DataFrame:
    """Predicted leaves that are not allowed, not in the truth, or differ from it, over predicted ones (1 at least)."""
    wrong = F.col("has_pred") & (~F.col("path").isin(allowed) | ~F.col("has_gt") | ~F.col("hit"))
    n = F.count_if(F.col("has_pred"))
    return compared.groupBy(*by).agg(n.alias("n_pred"), F.count_if(wrong).alias("n_wrong"), (F.count_if(wrong) / F.greatest(F.lit(1), n)).alias("rate"))


def confusion_rate(cells: DataFrame, classes: int) -> DataFrame:
    """(confused, total, rate) of cells (actual, predicted, n): counts off the diagonal over all, among the first ``classes`` only."""
    n = F.when((F.col("actual") < classes) & (F.col("predicted") < classes), F.col("n")).otherwise(0)
    sums = cells.agg(F.coalesce(F.sum(F.when(F.col("actual") != F.col("predicted"), n)), F.lit(0)).alias("confused"), F.coalesce(F.sum(n), F.lit(0)).alias("total"))
    return sums.select("confused", "total", safe_div(F.col("confused"), F.col("total")).alias("rate"))


def class_accuracy(cells: DataFrame, classes: int, over: str = "actual") -> DataFrame:
    """(cls, accuracy): the diagonal over all cells of a class, by ``over``; a class without cells has 0."""
    sums = cells.where(F.col(over) < classes).groupBy(F.col(over).alias("cls")).agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("all"))
    return sums.select("cls", safe_div(F.col("hit"), F.col("all")).alias("accuracy"))


def false_positive_rate(cells: DataFrame, cls: int, background: int) -> DataFrame:
    """(wrong, total, rate): background taken for a class, over all cells of the background."""
    sums = cells.where(F.col("actual") == background).agg(F.coalesce(F.sum(F.when(F.col("predicted") == cls, F.col("n"))), F.lit(0)).alias("wrong"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return sums.select("wrong", "total", safe_div(F.col("wrong"), F.col("total")).alias("rate"))


def fold_results(epochs: DataFrame, fold: str, order: str, score: str, best: list[str], last: list[str]) -> DataFrame:
    """One row for each fold: ``best`` columns of its epoch with the greatest score (null: 0; ties: the first), ``last`` columns of its last epoch."""
    top = F.struct(F.coalesce(F.col(score), F.lit(0.0)).alias("_score"), (-F.col(order)).alias("_order"), F.struct(*best).alias("row"))
    end = F.struct(F.col(order).alias("_order"), F.struct(F.lit(True).alias("_any"), *last).alias("row"))
    picked = epochs.groupBy(fold).agg(F.max(top).alias("top"), F.max(end).alias("end"))
    return picked.select(fold, (-F.col("top._order")).alias("best_" + order), *(F.col(f"top.row.{c}") for c in best), *(F.col(f"end.row.{c}").alias("last_" + c) for c in last))


def best_fold(results: DataFrame, fold: str, score: str) -> DataFrame:
    """The fold with the greatest score, the first on a tie; no row where none has one."""
    return results.where(F.col(score).isNotNull()).orderBy(F.desc(score), fold).limit(1)


def batch_summary(runs: DataFrame, ok: str, seconds: str) -> DataFrame:
    """(n_total, n_ok, n_err, total_seconds, avg_seconds) of a batch; nothing run: zeros."""
    good, total = F.count_if(F.col(ok)), F.coalesce(F.sum(seconds), F.lit(0.0))
    n = F.count(F.lit(1))
    return runs.agg(n.alias("n_total"), good.alias("n_ok"), (n - good).alias("n_err"), F.round(total, 1).alias("total_seconds"), F.round(F.round(total, 1) / F.greatest(F.lit(1), n), 2).alias("avg_seconds"))


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed and keys."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def unmatched(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Requested keys that were not found, each once."""
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")
