"""Training samples: pairs of an image and its document, with class, target sequence and group key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.records import encode_tags
from tessera.functions.text import group_key_patch

# The token that opens the sequence of each class, and the marks at which a name is cut to its group.
TASKS = {
    "Measure": "<s_measure>",
    "GDT": "<s_gdt>",
    "Roughness": "<s_roughness>",
}
MARKS = ("__View_", "__Measure_", "__GDT_", "__Roughness_")


def folder_class(path: Column, folders: int = 3) -> Column:
    """The nearest of so many parent folders whose name is a class; null without one."""
    above = F.slice(F.reverse(F.split(path, "/")), 2, folders)
    return F.get(F.filter(above, lambda f: f.isin(*TASKS)), 0)


def sample_rows(pairs: DataFrame, file: str = "file", document: str = "document") -> DataFrame:
    """(file, cls, target, group_key, document) of pairs (file, JSON text); pairs that are no sample go.

    The class is the document's ``type``, or that of a folder above the file where it says none; pairs of other classes
    or with a document that does not parse are none. The target is the class's token and the document as tags.
    """
    told = F.nullif(F.try_variant_get(F.try_parse_json(document), "$.type", "string"), F.lit(""))
    rows = pairs.select(F.col(file).alias("file"), F.col(document).alias("document"), F.coalesce(told, folder_class(F.col(file))).alias("cls"))
    rows = rows.where(F.try_parse_json("document").isNotNull() & F.col("cls").isin(*TASKS))
    token = reduce(lambda rest, c: F.when(F.col("cls") == c, TASKS[c]).otherwise(rest), TASKS, F.lit(None).cast("string"))
    return encode_tags(rows, "document").select("file", "cls", F.concat(token, "tags").alias("target"), group_key_patch(F.col("file"), MARKS).alias("group_key"), "document")


def read_samples(spark: SparkSession, path: str, image: str = "jpg") -> DataFrame:
    """The samples below a path: every image that has a ``.json`` of the same name beside it. Images are listed, not read."""
    below = spark.read.option("recursiveFileLookup", True)
    images = below.format("binaryFile").option("pathGlobFilter", f"*.{image}").load(path).select(F.col("path").alias("file"))
    documents = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("document"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"\.[^./]+$", "")
    return sample_rows(images.join(documents, plain(F.col("file")) == plain(F.col("at"))).select("file", "document"))
