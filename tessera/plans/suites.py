"""Validation suites: each turns tables of predictions, labels or documents into checked values.

A suite gives one row for each check: (suite, name, cls, value, threshold, direction, severity, status). Values come from
one aggregation; only the threshold table, a short list of literals, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators.metrics import safe_div
from tessera.plans.gates import status

# Suite, check, class ("" for all), threshold, direction, severity.
THRESHOLDS = [
    ("sorter", "classifier_accuracy", "", 0.85, "ge", "critical"),
    ("sorter", "per_language_accuracy", "*", 0.80, "ge", "warning"),
    ("sorter", "manual_review_rate", "", 0.20, "le", "warning"),
    ("sorter", "error_rate", "", 0.01, "le", "warning"),
    ("box_labels", "empty_label_rate", "", 0.05, "le", "critical"),
    ("box_labels", "parse_error_rate", "", 0.0, "le", "critical"),
    ("box_labels", "validity_rate", "", 1.0, "ge", "critical"),
    ("box_labels", "small_rate", "", 0.05, "le", "warning"),
    ("box_labels", "class_ratio", "PMI", 0.50, "ge", "warning"),
    ("box_labels", "class_ratio", "View", 0.05, "ge", "warning"),
    ("box_labels", "class_ratio", "TitleBlock", 0.04, "ge", "warning"),
    ("box_labels", "class_ratio", "Notes", 0.01, "ge", "warning"),
    ("box_labels", "class_ratio", "Isometric", 0.005, "ge", "warning"),
    ("quad_labels", "validity_rate", "", 1.0, "ge", "critical"),
    ("quad_labels", "class_count", "Roughness", 50.0, "ge", "warning"),
    ("quad_labels", "non_axis_aligned_rate", "", 0.20, "ge", "warning"),
    ("detections", "missing_rate", "Measure", 0.08, "le", "critical"),
    ("detections", "missing_rate", "GDT", 0.05, "le", "critical"),
    ("detections", "missing_rate", "Roughness", 0.30, "le", "warning"),
    ("detections", "drawing_recall", "", 0.85, "ge", "critical"),
    ("region_text", "field_f1", "", 0.50, "ge", "warning"),
    ("region_text", "field_f1", "titleblock", 0.50, "ge", "warning"),
    ("region_text", "field_f1", "notes", 0.75, "ge", "critical"),
    ("region_text", "hallucination_rate", "", 0.50, "le", "warning"),
    ("region_text", "empty_response_rate", "", 0.10, "le", "warning"),
    ("region_text", "language_f1_gap", "", 0.30, "le", "info"),
    ("numeric", "field_f1", "Measure", 0.90, "ge", "critical"),
    ("numeric", "field_f1", "GDT", 0.95, "ge", "critical"),
    ("numeric", "field_f1", "Roughness", 0.95, "ge", "warning"),
    ("numeric", "numerical_accuracy", "", 0.95, "ge", "critical"),
    ("numeric", "tolerance_match", "", 0.90, "ge", "critical"),
    ("numeric", "hallucination_rate", "", 0.10, "le", "critical"),
    ("end_to_end", "field_f1", "", 0.75, "ge", "critical"),
    ("end_to_end", "seconds_per_drawing", "", 30.0, "le", "warning"),
    ("end_to_end", "failure_rate", "", 0.01, "le", "critical"),
    ("enrichment", "llm_method_rate", "", 0.40, "le", "warning"),
    ("enrichment", "flag_rate", "", 0.25, "le", "warning"),
    ("enrichment", "empty_rate", "", 0.10, "le", "warning"),
    ("enrichment", "provenance", "", 1.0, "ge", "critical"),
]


def checked(values: DataFrame, suite: str) -> DataFrame:
    """(name, cls, value) against the thresholds of a suite; class ``*`` stands for every class; no threshold: INFO."""
    rows = [t[1:] for t in THRESHOLDS if t[0] == suite]
    table = values.sparkSession.createDataFrame(rows, "t_name string, t_cls string, threshold double, direction string, severity string")
    meets = (F.col("name") == F.col("t_name")) & ((F.col("cls") == F.col("t_cls")) | ((F.col("t_cls") == "*") & (F.col("cls") != "")))
    out = values.join(F.broadcast(table), meets, "left")
    state = status(F.col("value"), F.col("threshold"), F.col("direction"), F.col("severity"))
    return out.select(F.lit(suite).alias("suite"), "name", "cls", "value", "threshold", "direction", "severity", state.alias("status"))


def unpivoted(totals: DataFrame, names: list[str], cls: Column | None = None) -> DataFrame:
    """Columns of aggregated rows as (name, cls, value)."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))
    return totals.select((F.lit("") if cls is None else cls).alias("cls"), F.explode(pairs).alias("p")).select("p.name", "cls", "p.value")


def rate(condition: Column) -> Column:
    return safe_div(F.count_if(condition), F.count(F.lit(1)))


def sorter_suite(manifest: DataFrame, truth: DataFrame, language: Column) -> DataFrame:
    """manifest (filename, decision), truth (filename, actual): rates over all rows, accuracy over those with a decision and a truth.

    Decisions: stage1_titleblock and stage2_no_titleblock predict, manual_review does not, ``error`` is a failure.
    """
    predicted = F.when(F.col("decision") == "stage1_titleblock", 1).when(F.col("decision") == "stage2_no_titleblock", 0)
    rows = manifest.join(truth, "filename", "left").select(language.alias("lang"), "decision", predicted.alias("p"), F.col("actual").cast("int").alias("a"))
    both = F.col("p").isNotNull() & F.col("a").isNotNull()
    right = safe_div(F.count_if(both & (F.col("p") == F.col("a"))), F.count_if(both))
    out = rows.rollup("lang").agg(
        rate(F.col("decision") == "manual_review").alias("manual_review_rate"), rate(F.col("decision") == "error").alias("error_rate"),
        F.when(F.count_if(both) > 0, right).alias("classifier_accuracy"), F.grouping("lang").alias("all"),
    )
    whole = unpivoted(out.where("`all` = 1"), ["manual_review_rate", "error_rate", "classifier_accuracy"])
    each = out.where("`all` = 0").withColumnRenamed("classifier_accuracy", "per_language_accuracy")
    return checked(whole.unionByName(unpivoted(each, ["per_language_accuracy"], F.coalesce("lang", F.lit("_unknown")))), "sorter")


def box_label_suite(files: DataFrame, rows: DataFrame, classes: list[str], least_area: float = 1e-4) -> DataFrame:
    """files (file), rows (file, cls, values, error) as read_labels gives them: rates over files, over lines and over parsed boxes.

    A file without any line is empty. Class ratios are dense over ``classes``; without boxes they are 0.
    """
    n = files.join(rows.select("file").distinct().withColumn("some", F.lit(True)), "file", "left")
    empty = n.agg(rate(F.col("some").isNull()).alias("empty_label_rate"))
    v = [F.get("values", i) for i in range(4)]
    good, total = F.col("error") == "", F.count_if(F.col("error") == "")
    issues = G.bbox_issues(F.col("cls"), *v, len(classes))
    counts = [F.count_if(good & (F.col("cls") == i)).alias(f"c{i}") for i in range(len(classes))]
    per = rows.agg(
        rate(F.col("error") != "").alias("parse_error_rate"), F.when(total > 0, F.count_if(good & (F.size(issues) == 0)) / total).alias("validity_rate"),
        safe_div(F.count_if(good & (v[2] * v[3] < least_area)), total).alias("small_rate"), total.alias("n"), *counts,
    )
    ratios = per.select(F.explode(F.array(*(F.struct(F.lit("class_ratio").alias("name"), F.lit(c).alias("cls"), safe_div(F.col(f"c{i}"), F.col("n")).alias("value")) for i, c in enumerate(classes)))).alias("r")).select("r.*")
    return checked(unpivoted(empty, ["empty_label_rate"]).unionByName(unpivoted(per, ["parse_error_rate", "validity_rate", "small_rate"])).unionByName(ratios), "box_labels")


def quad_label_suite(rows: DataFrame, classes: list[str]) -> DataFrame:
    """rows (cls, values of four points in 0..1): validity, angles away from the axes, counts of each class."""
    q = [(F.get("values", 2 * i), F.get("values", 2 * i + 1)) for i in range(4)]
    inside = ~F.exists("values", lambda v: (v < 0) | (v > 1))
    valid = F.col("cls").between(0, len(classes) - 1) & inside & (G.quad_area(q) > 0) & G.is_simple_quad(q)
    per = rows.agg(
        F.when(F.count(F.lit(1)) > 0, rate(valid)).alias("validity_rate"), rate(~G.is_axis_aligned(G.long_edge_angle(q))).alias("non_axis_aligned_rate"),
        *(F.count_if(F.col("cls") == i).alias(f"c{i}") for i in range(len(classes))),
    )
    counts = per.select(F.explode(F.array(*(F.struct(F.lit("class_count").alias("name"), F.lit(c).alias("cls"), F.col(f"c{i}").cast("double").alias("value")) for i, c in enumerate(classes)))).alias("r")).select("r.*")
    return checked(unpivoted(per, ["validity_rate", "non_axis_aligned_rate"]).unionByName(counts), "quad_labels")


def detection_suite(matches: DataFrame, truth: DataFrame, key: str, empty: float | None = None) -> DataFrame:
    """Missing rate of each class and overall, and the mean recall of a drawing.

    ``empty``: recall of a drawing without truth (null: left out). Inputs as match_predictions takes and gives them.
    """
    p = matches.select(key, "cls", F.col("gt_pos").isNotNull().cast("long").alias("tp"), F.lit(0).alias("gt"))
    g = truth.select(key, "cls", F.lit(0).alias("tp"), F.lit(1).alias("gt"))
    cells = p.unionByName(g).groupBy(key, "cls").agg(F.sum("tp").alias("tp"), F.sum("gt").alias("gt"))
    by_class = cells.rollup("cls").agg(safe_div(F.sum("gt") - F.sum("tp"), F.sum("gt")).alias("missing_rate"), F.grouping("cls").alias("all"))
    drawing = cells.groupBy(key).agg(F.when(F.sum("gt") > 0, F.sum("tp") / F.sum("gt")).otherwise(F.lit(empty).cast("double")).alias("r"))
    whole = drawing.agg(F.avg("r").alias("drawing_recall"))
    cls = F.when(F.col("all") == 1, "").otherwise(F.coalesce(F.col("cls").cast("string"), F.lit("_unknown")))
    return checked(unpivoted(by_class, ["missing_rate"], cls).unionByName(unpivoted(whole, ["drawing_recall"])), "detections")


def field_suite(compared: DataFrame, suite: str, cls: str, allowed: list[str], lang: str | None = None) -> DataFrame:
    """Field F1 overall and by class, hallucination rate, and the gap between languages, of compare_leaves rows.

    ``suite``: region_text or numeric. Rows hold the columns named by ``cls`` and ``lang``.
    """
    hp, hg, hit = F.col("has_pred"), F.col("has_gt"), F.col("hit")

    def f1(rows: DataFrame, by: str) -> DataFrame:
        tp, p, g = F.count_if(hit), F.count_if(hp), F.count_if(hg)
        return rows.rollup(by).agg(safe_div(2 * tp, p + g).alias("field_f1"), safe_div(F.count_if(hp & (~F.col("path").isin(allowed) | ~hg | ~hit)), p).alias("hallucination_rate"), F.grouping(by).alias("all"))

    per = f1(compared, cls)
    name = F.when(F.col("all") == 1, "").otherwise(F.coalesce(F.col(cls).cast("string"), F.lit("_unknown")))
    out = unpivoted(per, ["field_f1"], name).unionByName(unpivoted(per.where("`all` = 1"), ["hallucination_rate"]))
    if lang is not None:
        gap = f1(compared, lang).where("`all` = 0").agg((F.max("field_f1") - F.min("field_f1")).alias("language_f1_gap"))
        out = out.unionByName(unpivoted(gap, ["language_f1_gap"]))
    return checked(out, suite)


def run_suite(documents: DataFrame) -> DataFrame:
    """documents (f1, seconds, failed) of a batch: macro F1, mean seconds, share of failures."""
    per = documents.agg(F.avg("f1").alias("field_f1"), F.avg("seconds").alias("seconds_per_drawing"), rate(F.col("failed")).alias("failure_rate"))
    return checked(unpivoted(per, ["field_f1", "seconds_per_drawing", "failure_rate"]), "end_to_end")


def enrichment_suite(fields: DataFrame) -> DataFrame:
    """fields (suggested, confidence, method, flagged): rates over all suggested fields; provenance over three parts of each."""
    lacks = sum((F.count_if(F.col(c).isNull()) for c in ("confidence", "method")), F.count_if(F.col("suggested").isNull()))
    n = F.count(F.lit(1))
    per = fields.agg(
        rate(F.col("method") == "llm").alias("llm_method_rate"), rate(F.col("flagged")).alias("flag_rate"),
        rate(F.coalesce(F.col("suggested"), F.lit("")) == "").alias("empty_rate"), F.when(n > 0, 1 - lacks / (n * 3)).alias("provenance"),
    )
    return checked(unpivoted(per, ["llm_method_rate", "flag_rate", "empty_rate", "provenance"]), "enrichment")
