"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams are scaled by the log ratio of their smoothed frequencies in the two classes; a linear
model with hinge loss is fitted on them by dual coordinate descent, and its margins are turned into
probabilities. The model is fitted in one task on a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

ORDERS, BITS = (1, 3, 4), 17
#: Labelled rows that are fitted on, at most (about).
SAMPLE = 12_000


def fit(rows: list[np.ndarray], label: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, smooth: float = 1.0) -> np.ndarray:
    """Weights of ``size`` indicators, bias, slope and shift of the probability. ``label``: 0 or 1."""
    out = np.zeros(size + 3, dtype=np.float64)
    good = label == 1
    if not len(rows) or good.all() or not good.any():
        out[size + 2] = 0.0 if not len(rows) else (4.0 if good.all() else -4.0)
        return out
    count = [np.full(size, smooth), np.full(size, smooth)]
    for r, y in zip(rows, label, strict=True):
        count[int(y)][r] += 1
    ratio = np.log(count[1] / (good.sum() + 2 * smooth)) - np.log(count[0] / ((~good).sum() + 2 * smooth))
    sign = np.where(good, 1.0, -1.0)
    # Classes weigh alike in the loss.
    limit = cost * np.where(good, len(rows) / (2 * good.sum()), len(rows) / (2 * (~good).sum()))
    values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    margin = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values, strict=True)])
    slope, shift = _probability(margin, good.astype(np.float64))
    out[:size], out[size:] = w * ratio, (bias, slope, shift)
    return out


def _probability(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps, with labels drawn in from 0 and 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - t) + ridge * (beta - [1, 0]))
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in C.text_blocks(batches):
        row, index = C.gram_sets(data, offsets, ORDERS, BITS)
        yield pa.record_batch({"doc_id": part.column("doc_id"), "y": part.column("y"), "grams": C.list_column(index.astype(np.int32), np.bincount(row, minlength=part.num_rows), pa.int32())})


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, label, ids = [], [], []
    for b in batches:
        grams = b.column("grams")
        rows += [np.asarray(grams[i].values) for i in range(b.num_rows)]
        label += b.column("y").to_pylist()
        ids += b.column("doc_id").cast(pa.string()).to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (ids[i], label[i], len(rows[i])))  # the fit does not depend on the tasks' order
    model = fit([rows[i] for i in order], np.array([label[i] for i in order], dtype=np.int64), 1 << BITS)
    yield pa.record_batch({"model": pa.array([model.astype("<f4").tobytes()], pa.binary())})


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """Fit on about ``sample`` rows at most of ``docs`` (doc_id, text) with a label (doc_id, quality 0 or 1)."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").cast("int").alias("y"))
    known = marks.where(~C.held_out("label_id"))
    known = C.bounded_sample(known, sample, "label_id")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "y", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    grams = rows.mapInArrow(_features, f"doc_id {kind}, y int, grams array<int>")
    found = grams.repartition(1).mapInArrow(_train, "model binary").first()
    return bytes(found["model"]) if found else fit([], np.zeros(0), 1 << BITS).astype("<f4").tobytes()


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.frombuffer(model.value, dtype="<f4").astype(np.float64)
        weight, (bias, slope, shift) = got[:-3], got[-3:]
        for part, data, offsets in C.text_blocks(batches):
            row, index = C.gram_sets(data, offsets, ORDERS, BITS)
            n = part.num_rows
            size = np.maximum(np.bincount(row, minlength=n), 1)
            margin = np.bincount(row, weights=weight[index], minlength=n) / np.sqrt(size) + bias
            score = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(score), "margin": pa.array(margin)})

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, score, margin) of every row; only the text makes the score.

    score: 0 to 1, higher where quality 1 is likelier. Null and empty texts get the model's score of no
    n-grams. Rows whose crc32(doc_id as text) mod 3 is 1 are held out of the fit; a null doc_id has no label and
    is not held out. Labels other than 0 and 1 are ignored; of several for one id the largest counts. Without
    labels of both classes all scores are alike. Repeated rows get equal scores; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    model = spark.sparkContext.broadcast(train_quality(docs, labels, sample))  # 2 ** BITS floats
    rows = docs.select("doc_id", C.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, margin double")
