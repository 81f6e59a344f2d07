"""Readers of label and list files: text in, typed rows and an error column out, never a failed read."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_label(line: Column, fields: int) -> Column:
    """struct(cls, values, error) of a label line of ``fields`` fields (5: boxes, 9: quadrilaterals); notes and blanks are ``skip``."""
    text = F.trim(line)
    parts = F.split(text, r"\s+")
    cls = F.element_at(parts, 1).try_cast("int")
    values = F.transform(F.slice(parts, 2, fields - 1), lambda x: x.try_cast("double"))
    skip = (text == "") | text.startswith("#")
    wrong = F.size(parts) != fields
    bad = cls.isNull() | F.exists(values, lambda v: v.isNull())
    error = F.when(skip, "skip").when(wrong, "field_count").when(bad, "not_a_number").otherwise("")
    return F.struct(F.when(~skip & ~wrong, cls).alias("cls"), F.when(error == "", values).alias("values"), error.alias("error"))


def read_labels(spark: SparkSession, path: str, fields: int = 5) -> DataFrame:
    """(file, line_no, cls, values, error) of all label files under a path; skipped lines are left out."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    rows = lines.select("file", (F.col("i") + 1).alias("line_no"), parse_label(F.col("line"), fields).alias("p"))
    return rows.select("file", "line_no", "p.*").where("error <> 'skip'")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One key a line; notes after ``#`` and blanks are dropped; each key once."""
    key = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(key.alias("key")).where("key <> ''").distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header: names and values trimmed, a byte-order mark dropped, nulls empty."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip()) for c in raw.columns))


def read_json_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".enriched",), recursive: bool = True) -> DataFrame:
    """(file, stem, doc, bad): whole files as variants; what does not parse is null and marked.

    A suffix before ``.json`` is no part of the stem. ``recursive``: folders below the path, too.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), "value")
    ends = "|".join(re.escape(x) for x in suffixes)
    name = F.regexp_extract("file", rf"([^/]+?)(?:{ends})?\.json$", 1)
    rows = raw.select("file", name.alias("stem"), F.try_parse_json("value").alias("doc")).where("stem not like '\\_%' and stem <> 'manifest'")
    return rows.withColumn("bad", F.col("doc").isNull())


def preferred(documents: DataFrame, suffix: str = ".enriched") -> DataFrame:
    """One document of each stem: a file with the suffix before one without, then the first by path."""
    return one_of_each(documents, "stem", [F.desc(F.col("file").endswith(f"{suffix}.json")), "file"])


def lenient_class(line: Column, classes: int) -> Column:
    """Class of a label line by its first word alone; null where that is no number of a class."""
    first = F.get(F.split(F.trim(line), r"\s+"), 0)
    cls = F.when(first.rlike(r"^\d+$"), first.try_cast("int"))
    return F.when(cls.between(0, classes - 1), cls)


def class_counts(lines: DataFrame, file: str, line: str, classes: int) -> DataFrame:
    """(file, c0, c1 ...): lines of each class in a file, by ``lenient_class``; a file without any has zeros."""
    return lines.select(file, lenient_class(F.col(line), classes).alias("cls")).groupBy(file).agg(*(F.count_if(F.col("cls") == c).alias(f"c{c}") for c in range(classes)))


def lenient_rows(lines: DataFrame, line: str, fields: int = 5, classes: list[int] | None = None) -> DataFrame:
    """Lines that parse, of the given classes, with ``cls`` and ``values``; all others are dropped without a word."""
    rows = lines.withColumn("parsed", parse_label(F.col(line), fields)).where("parsed.error = ''")
    rows = rows.select(*lines.columns, "parsed.cls", "parsed.values")
    return rows if classes is None else rows.where(F.col("cls").isin(classes))


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """(fold, ...) of training logs in CSV, a folder for each fold: header names trimmed, values as numbers or null.

    ``fold`` is the number at the end of the folder's name.
    """
    raw = spark.read.csv(path, header=True, recursiveFileLookup=True, pathGlobFilter="results.csv")
    fold = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)/results\.csv$", 1).try_cast("int")
    return raw.select(fold.alias("fold"), *(F.trim(F.col(f"`{c}`")).try_cast("double").alias(c.strip()) for c in raw.columns))


def class_names(found: dict | list) -> list[str]:
    """Names in order of their numbers, from a list or an object of a data set's configuration."""
    return [found[k] for k in sorted(found, key=int)] if isinstance(found, dict) else list(found)


def read_thresholds(text: str) -> dict[str, dict]:
    """Thresholds of a JSON text as a flat dict: dotted path -> node with ``threshold``."""
    out: dict[str, dict] = {}

    def walk(node: object, path: str) -> None:
        if isinstance(node, dict):
            if "threshold" in node:
                out[path] = node
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else k)

    walk(json.loads(text), "")
    return out


def threshold_of(thresholds: dict[str, dict], path: str, aliases: dict[str, str]) -> dict | None:
    """A threshold by its dotted path; else by the other name, either way, of the last part; else None."""
    head, _, name = path.rpartition(".")
    other = {v: k for k, v in aliases.items()}.get(name) or aliases.get(name)
    return thresholds.get(path) or (thresholds.get(f"{head}.{other}" if head else other) if other else None)


IMAGE_KINDS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def list_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = IMAGE_KINDS) -> DataFrame:
    """(file, stem, size) of the files below a path with such endings, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    end = reduce(lambda a, b: a | b, (F.lower("file").endswith(k) for k in kinds))
    return files.where(end).select("file", F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("stem"), "size")


def labelled(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (stem, file) that have a label file (stem, size) with anything in it."""
    return images.join(labels.where("size > 0").select("stem"), "stem", "left_semi")


def seed_stems(splits: list[DataFrame]) -> DataFrame:
    """Stems of all splits, each once."""
    return reduce(DataFrame.unionByName, (s.select("stem") for s in splits)).distinct()


def read_annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """Image elements of annotation XML files, attributes with a leading underscore."""
    return spark.read.format("xml").option("rowTag", "image").load(path)


IMAGES = "_name string, _width int, _height int, box array<struct<_label string, _xtl double, _ytl double, _xbr double, _ybr double, attribute array<struct<_name string, _VALUE string>>>>"


def skip_reasons(spark: SparkSession, path: str, label: str = "SKIP", attribute: str = "reason", default: str = "stage1_fp_other") -> DataFrame:
    """(reason, file), each once, of the boxes with a label in annotation XML: the attribute's text, else the default."""
    boxes = spark.read.format("xml").option("rowTag", "image").schema(IMAGES).load(path).select(F.element_at(F.split("_name", "/"), -1).alias("file"), F.explode("box").alias("b"))
    given = F.filter(F.transform(F.filter("b.attribute", lambda a: a["_name"] == attribute), lambda a: F.trim(a["_VALUE"])), lambda v: v != "")
    return boxes.where(F.col("b._label") == label).select(F.coalesce(F.get(given, 0), F.lit(default)).alias("reason"), "file").where("file <> ''").distinct()


def scaled_boxes(spark: SparkSession, path: str, factor: float) -> DataFrame:
    """(image, width, height, label, xtl, ytl, xbr, ybr) of annotation XML, scaled; corners to two decimals, sizes to whole pixels."""
    boxes = spark.read.format("xml").option("rowTag", "image").schema(IMAGES).load(path).select("_name", "_width", "_height", F.explode("box").alias("b"))
    size = lambda c: F.bround(F.col(c) * factor, 0).cast("int").alias(c[1:])
    return boxes.select(F.col("_name").alias("image"), size("_width"), size("_height"), F.col("b._label").alias("label"), *(F.round(F.col(f"b._{c}") * factor, 2).alias(c) for c in ("xtl", "ytl", "xbr", "ybr")))


def is_true(value: Column) -> Column:
    """1 for the ways in which a truth table writes yes, else 0."""
    return F.when(F.lower(F.trim(value)).isin("1", "true", "y", "yes", "tb"), 1).otherwise(0)


def one_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in an order: first wins, last wins (descending) or a precedence of sources."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def pairs(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(stem, label, image) of files (stem, file); a side is null where a file has no partner."""
    return labels.select("stem", F.col("file").alias("label")).join(images.select("stem", F.col("file").alias("image")), "stem", "full_outer")
