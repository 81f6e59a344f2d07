"""Writers: partitioned by Spark, one file for each key only where a format asks for it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; ``mark``: the first name of each file starts with a byte-order mark, as spreadsheets want."""
    if mark and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).csv(path)


def label_line(cls, *values):
    return F.format_string("%d " + " ".join(["%.6f"] * len(values)), cls, *values)


def write_labels(rows: DataFrame, path: str, split: str = "split") -> None:
    """Rows (split, line) as text, a folder for each split."""
    rows.select(split, "line").write.mode("overwrite").partitionBy(split).text(path)


def data_yaml(names: list[str], **paths: str) -> str:
    """A data set's configuration: paths, names by number and their count."""
    return "\n".join([*(f"{k}: {v}" for k, v in paths.items()), "", "names:", *(f"  {i}: {n}" for i, n in enumerate(names)), "", f"nc: {len(names)}", ""])


def write_folds(rows: DataFrame, path: str) -> None:
    """Rows (fold, split, file) as lists of files, a folder for each fold and split, in order."""
    rows.select("fold", "split", "file").repartition("fold", "split").sortWithinPartitions("fold", "split", "file").write.mode("overwrite").partitionBy("fold", "split").text(path)


def write_reasons(skips: DataFrame, path: str) -> None:
    """Rows (reason, file) as sorted lists, each file once: a folder for each reason and ``all`` for all of them."""
    every = skips.select(F.lit("all").alias("reason"), "file")
    both = skips.select("reason", "file").unionByName(every).distinct()
    both.repartitionByRange("reason", "file").sortWithinPartitions("reason", "file").write.mode("overwrite").partitionBy("reason").text(path)


def append_records(records: DataFrame, path: str, key: str) -> DataFrame:
    """Adds the records whose key is not in the store at ``path`` yet, each key once (the first by all columns); returns what was added.

    The store is Parquet and grows by one batch; nothing that is there is written again. What comes back is read
    from the store, so it stays the same after later batches.
    """
    spark, names = records.sparkSession, [c for c in records.columns if c != key]
    batch = uuid.uuid4().hex
    new = records.groupBy(key).agg(F.min(F.struct(*names)).alias("rest")).select(key, "rest.*").select(*records.columns)
    try:
        known = spark.read.parquet(path).select(key)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = None
    if known is not None:
        new = new.join(known, key, "left_anti")
    new.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(new.withColumn("batch", F.lit(batch)).schema).parquet(path).where(F.col("batch") == batch).drop("batch")


def free_name(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """``target`` of files that go to one folder: the name, with ``_1``, ``_2`` ... before its ending where it is taken."""
    place = F.row_number().over(Window.partitionBy(folder, name).orderBy("file")) - 1
    end = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.expr(f"substring({name}, 1, length({name}) - length(regexp_extract({name}, '([.][^.]*)$', 1)))")
    return rows.withColumn("target", F.concat_ws("/", folder, F.when(place == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), place.cast("string"), end))))
