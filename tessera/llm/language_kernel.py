"""Language ID by string kernels: presence kernels of blended n-grams, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of (hashed) byte n-grams of 1 to 3 bytes that both have, over the root of
the product of their numbers. Landmarks are texts of every language; one-versus-rest ridge regression is solved
in the space they span. A block of texts is scored by two matrix products: with the landmarks' indicators, and
with the coefficients.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import common as C

ORDERS, BITS = (1, 2, 3), 12
#: Texts of each language that are fitted on, at most (about), and of all; landmarks of each; ridge.
SAMPLE, TOTAL, LANDMARKS, RIDGE = 400, 16_000, 24, 1e-2


def indicators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence of each n-gram, a unit vector for each text with any."""
    row, index = C.gram_sets(C.LOWER[data], offsets, ORDERS, BITS)
    n = len(offsets) - 1
    out = np.zeros((n, 1 << BITS), dtype=np.float32)
    out[row, index] = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)))[row]
    return out


def fit(x: np.ndarray, lang: list[str]) -> dict:
    names = sorted(set(lang))
    if not names:
        return {"names": [], "landmarks": np.zeros((0, 1 << BITS), np.float32), "alpha": np.zeros((0, 0))}
    chosen = [i for n in names for i in [k for k, v in enumerate(lang) if v == n][:LANDMARKS]]
    marks = x[chosen]
    k_nm, k_mm = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    share = np.array([1 / lang.count(v) for v in lang]) * len(lang) / len(names)  # languages weigh alike
    y = np.array([[1.0 if v == n else -1.0 for n in names] for v in lang])
    left = k_nm.T @ (k_nm * share[:, None]) + RIDGE * len(lang) * (k_mm + 1e-6 * np.eye(len(chosen))) / len(chosen)
    return {"names": names, "landmarks": marks, "alpha": np.linalg.lstsq(left, k_nm.T @ (y * share[:, None]), rcond=None)[0]}


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, lang, ids = [np.zeros((0, 1 << BITS), np.float32)], [], []
    for part, data, offsets in C.text_blocks(batches):
        x.append(indicators(data, offsets))
        lang += part.column("lang").to_pylist()
        ids += part.column("id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], lang[i]))
    yield pa.record_batch({"model": pa.array([pickle.dumps(fit(np.concatenate(x)[order], [lang[i] for i in order]))], pa.binary())})


def train_languages(docs: DataFrame, sample: int = SAMPLE) -> bytes:
    """Fit on about ``sample`` texts at most of each lang, and TOTAL of all, of rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")) & ~C.held_out())
    rows = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = C.bounded_sample(rows, sample, "id", "lang", TOTAL)
    found = rows.repartition(1).mapInArrow(_fitted, "model binary").first()
    return bytes(found["model"]) if found else pickle.dumps(fit(np.zeros((0, 1 << BITS), np.float32), []))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def _predict(model, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pickle.loads(model.value)
        names, marks, alpha = got["names"], got["landmarks"].T, got["alpha"]
        for part, data, offsets in C.text_blocks(batches):
            n = part.num_rows
            if names:
                value = (indicators(data, offsets) @ marks).astype(np.float64) @ alpha
                best = value.argmax(axis=1)
                score = np.clip((1 + value[np.arange(n), best]) / 2, 0, 1)
            letter = np.asarray(part.column("has_letter").to_numpy(zero_copy_only=False)).astype(bool)
            lang = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letter, strict=True)] if names else ["und"] * n
            score = np.where(letter, score, 0.0) if names else np.zeros(n)
            columns = {c: part.column(c) for c in part.schema.names if c != "has_letter"}
            yield pa.record_batch(columns | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return run


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score) of every row; only the text is scored.

    lang_pred: a value of lang seen in the fit, or ``und`` (score 0) where the text is null, empty or has no
    letter, or where nothing could be learned. Rows whose crc32(doc_id as text) mod 3 is 1, with null lang or null
    doc_id are not learned from. Repeated rows get equal results; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    model = spark.sparkContext.broadcast(train_languages(docs, sample))  # bounded by languages times LANDMARKS
    rows = docs.select("doc_id", C.held_out().alias("held_out"), has_letter(F.col("text")).alias("has_letter"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in _predict(model)(batches):
            yield b.select(["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with its columns, whatever their names: those of ``und`` go."""
    model = docs.sparkSession.sparkContext.broadcast(train_languages(docs, sample))
    names = docs.columns
    rows = docs.select(C.packed(docs).alias("row"), has_letter(docs["text"]).alias("has_letter"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for b in _predict(model)(batches):
            yield b.filter(pa.compute.not_equal(b.column("lang_pred"), "und")).select(["row"])

    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select(*C.unpacked("row", names))
