"""Exact dedup with content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes has given bits clear, so equal texts are cut alike. Its recipe
is the ordered list of its chunks' fast keys. Only texts whose recipe another text has can be equal. The chunks of
those are deduplicated to verified identifiers: a fast key with several contents gets an identifier for each, told
apart by the bytes. Texts are equal when their ordered identifier lists are. Texts with a recipe of their own stay
in their task (but for few that a sieve of hashes mistakes), and of equal texts one is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.common import U, materialize

#: Least and most bytes of a chunk, and the bits that are clear at a cut (2 ** bits bytes between cuts on average).
LEAST, MOST, BITS = 512, 16384, 11
_GEAR = (C.mix(np.arange(256, dtype=np.uint64), 77) & U(0xFFFFFFFF)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place, by doubling."""
    h, width = _GEAR[data], 1
    while width < 32:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, as places in ``data``."""
    # A hash must only see bytes of its own text: cuts start LEAST (> 32) bytes in.
    marks = np.flatnonzero((rolling(data) >> np.uint32(32 - BITS)) == 0) + 1 if len(data) else np.zeros(0, dtype=np.int64)
    at, out = np.searchsorted(marks, offsets), []
    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        last, cuts = start, []
        for m in marks[at[i] : at[i + 1]].tolist():
            while m - last > MOST:
                last += MOST
                cuts.append(last)
            if LEAST <= m - last and m < end:
                last = m
                cuts.append(m)
        while end - last > MOST:
            last += MOST
            cuts.append(last)
        if end > last or not cuts:
            cuts.append(end)
        out.append(cuts)
    return out


def _chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all chunks: starts, ends, fast keys; and the number of each text's."""
    cuts = cut_points(data, offsets)
    counts = np.array([len(c) for c in cuts], dtype=np.int64)
    ends = np.array([x for c in cuts for x in c], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    starts[np.cumsum(counts) - counts] = offsets[:-1]
    return starts, ends, C.span_hash(C.prefix_hash(C.BYTE_CODE[data]), starts, ends), counts


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in C.text_blocks(batches):
        _, _, keys, counts = _chunked(data, offsets)
        yield pa.record_batch({
            "doc_id": part.column("doc_id"), "text_sha256": part.column("text_sha256"),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()), "recipe": C.list_column(C.signed(keys), counts, pa.int64()),
        })


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (fast key, bytes) of each block."""
    for _, data, offsets in C.text_blocks(batches):
        starts, ends, keys, _ = _chunked(data, offsets)
        raw = data.tobytes()
        found = {(k, raw[s:e]) for k, s, e in zip(C.signed(keys).tolist(), starts.tolist(), ends.tolist(), strict=True)}
        yield pa.record_batch({"key": pa.array([k for k, _ in found], pa.int64()), "chunk": pa.array([c for _, c in found], pa.binary())})


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of texts with an ambiguous key, in verified identifiers: the variant's number follows the key."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            known = {(v["key"], v["chunk"]): v["variant"] for v in one.column("variants")[0].as_py()}
            data, offsets = C.text_buffer(one.column("text"))
            starts, ends, keys, _ = _chunked(data, offsets)
            raw = data.tobytes()
            numbers = [known.get((k, raw[s:e]), 0) for k, s, e in zip(C.signed(keys).tolist(), starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch({"text_sha256": one.column("text_sha256"), "numbers": pa.array([numbers], pa.list_(pa.int32()))})


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_sha256, n_bytes, group_key, keep_id, group_size, kept) of every row.

    Rows are equal when their texts are (a null text is an empty one). keep_id: the largest doc_id among equal
    texts (null only if all are null), kept: this row is the one that stays. Of repeated rows with that doc_id
    exactly one is kept. An empty table gives an empty table; other columns are ignored.
    """
    again, alone = _grouped(docs)
    return again.unionByName(alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}))


def _place() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_sha256")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``exact_groups`` whose recipe another row has, and (doc_id, text_sha256, n_bytes, group_key) of the rest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = C.text_column(docs)
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    recipes = materialize(rows.mapInArrow(_recipes, f"doc_id {kind}, text_sha256 string, n_bytes long, recipe array<long>"), "recipes")
    recipes = recipes.withColumn("fast", F.md5(F.concat_ws(",", F.col("n_bytes").cast("string"), F.transform("recipe", lambda k: k.cast("string")))))
    shared = materialize(recipes.groupBy("fast").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    # Candidates: one text for each different content under a shared recipe; their chunks get verified identifiers.
    content = recipes.join(shared.select("fast"), "fast", "left_semi").groupBy("fast", "text_sha256").agg(F.min("doc_id").alias("doc_id"))
    content = materialize(content.select("doc_id", "text_sha256"), "content")
    wanted = C.sieve(content.select(_place()))
    texts = rows.where(wanted(_place())).join(content.select(F.col("doc_id").alias("c_id"), F.col("text_sha256").alias("c_sha")), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_sha256") == F.col("c_sha")))
    texts = texts.select("text", "text_sha256")
    chunks = texts.select("text").mapInArrow(_chunks, "key long, chunk binary")
    kinds = chunks.groupBy("key", F.sha2("chunk", 256).alias("chunk_sha"), F.octet_length("chunk").alias("len")).agg(F.first("chunk").alias("chunk"))
    variants = kinds.withColumn("variant", F.row_number().over(Window.partitionBy("key").orderBy("chunk")) - 1)
    unclear = materialize(variants.withColumn("most", F.max("variant").over(Window.partitionBy("key"))).where("most > 0").select("key", "chunk", "variant"), "variants")
    if unclear.isEmpty():  # every fast key stands for one content: the recipe is the list of verified identifiers
        marked = recipes.withColumn("group_key", F.col("fast"))
    else:
        hit = recipes.select("text_sha256", F.explode("recipe").alias("key")).distinct().join(unclear, "key").groupBy("text_sha256").agg(F.collect_list(F.struct("key", "chunk", "variant")).alias("variants"))
        numbers = texts.join(hit, "text_sha256").mapInArrow(_identified, "text_sha256 string, numbers array<int>")
        numbers = numbers.select("text_sha256", F.concat_ws(",", F.transform("numbers", lambda k: k.cast("string"))).alias("numbers")).dropDuplicates(["text_sha256"])
        marked = recipes.join(numbers, "text_sha256", "left").withColumn("group_key", F.concat_ws("/", "fast", "numbers"))
    marked = marked.select("doc_id", "text_sha256", "n_bytes", "fast", "group_key")
    again = marked.join(shared.select("fast"), "fast", "left_semi")
    # Written, so that both sides of the join are exchanges and a hot group's side of it can be split.
    groups = materialize(again.groupBy(F.col("group_key").alias("g")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    again = again.join(groups, F.col("group_key") == F.col("g")).drop("g", "fast")
    turn = F.row_number().over(Window.partitionBy(F.struct("group_key", "doc_id")).orderBy("text_sha256"))
    again = again.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (turn == 1))
    return again, marked.join(shared.select("fast"), "fast", "left_anti").drop("fast")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest doc_id (of null ids only, any one).

    All columns are kept, whatever their names. Only rows that a sieve takes for copies cross an exchange.
    """
    again = materialize(_grouped(docs)[0].select("doc_id", "text_sha256", "kept"), "again")
    kept = again.where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    doubtful = C.sieve(again.select(_place()))
    gone = again.select(F.col("doc_id").alias("a_id"), F.col("text_sha256").alias("a_sha")).distinct()
    rows = docs.select(C.packed(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.sha2(C.text_column(docs).cast("binary"), 256).alias("text_sha256"))
    clear, some = rows.where(~doubtful(_place())), rows.where(doubtful(_place()))
    alone = some.join(gone, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_sha256") == F.col("a_sha")), "left_anti")
    once = some.join(kept, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha"))).dropDuplicates(["keep_id", "keep_sha"])
    return clear.unionByName(alone).unionByName(once.select("row", "doc_id", "text_sha256")).select(*C.unpacked("row", docs.columns))
