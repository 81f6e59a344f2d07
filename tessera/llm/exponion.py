"""Centroid clustering (Lloyd's rounds) in exact integers, with exponion search.

Each vector keeps an upper bound on the distance to its centroid and a lower bound on that to any other. Where the
upper one is below the lower one, or below half the way to the nearest other centroid, the vector stays unseen. Else
only centroids inside a ball around its own are scanned, of radius twice the distance plus that way, along lists of
centroids sorted by their distance from it: the nearest and the second nearest are always among them. The radius is
inclusive and all bounds are rounded outwards, so ties are seen and go to the smaller number.

Vectors stay where they are: a round reads the table of vectors with their bounds, writes the next one, and adds up
each partition's vectors by cluster; only these sums are exchanged. What goes to all tasks are the centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, list_column, materialize, trim

#: Relative room for the roundings of a few floating-point operations.
ROOM = 1e-14
#: Vectors handled at once.
BLOCK = 4096


class Centroids(NamedTuple):
    """Where centroids are, how far they moved (rounded up), and each one's others by distance (rounded down)."""

    points: np.ndarray
    moved: np.ndarray
    order: np.ndarray
    away: np.ndarray


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + ROOM)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - ROOM)


def squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    gap = points - centers
    return np.einsum("ij,ij->i", gap, gap)


def prepared(points: list[list[int]], before: list[list[int]] | None) -> Centroids:
    now = np.array(points, dtype=np.int64)
    moved = np.zeros(len(now)) if before is None else _up(np.sqrt(squares(now, np.array(before, dtype=np.int64)).astype(np.float64)))
    apart = np.sqrt(np.stack([squares(now, c) for c in now]).astype(np.float64))
    np.fill_diagonal(apart, -1.0)  # a centroid comes first in its own list, and is left out of it
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return Centroids(now, moved, order, _down(np.take_along_axis(apart, order, axis=1)))


def full_scan(points: np.ndarray, centers: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones), and squared distances to it and to the second nearest."""
    n = len(points)
    best, second, cluster = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int32)
    for j, center in enumerate(centers.points):
        _nearer(np.arange(n), squares(points, center), np.full(n, j, dtype=np.int32), best, second, cluster)
    return cluster, best, second


def _nearer(at: np.ndarray, found: np.ndarray, number: np.ndarray, best: np.ndarray, second: np.ndarray, cluster: np.ndarray) -> None:
    """Take distances into account for the vectors ``at``; -1 stands for none yet."""
    first = (best[at] < 0) | (found < best[at]) | ((found == best[at]) & (number < cluster[at]))
    win, lose = at[first], at[~first]
    second[win] = best[win]
    best[win], cluster[win] = found[first], number[first]
    less = (second[lose] < 0) | (found[~first] < second[lose])
    second[lose[less]] = found[~first][less]


def exponion(points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids moved, and the number of distances taken."""
    k, moved = len(centers.points), centers.moved
    others = np.full(k, moved.max())
    if k > 1:
        top = int(np.argmax(moved))
        others[top] = np.delete(moved, top).max()
    upper, lower, cluster = _up(upper + moved[cluster]), _down(lower - others[cluster]), cluster.copy()
    lower = np.where(lower < 0, 0.0, lower)
    nearest = centers.away[:, 0] if k > 1 else np.full(k, np.inf)
    at = np.flatnonzero(~(upper < np.maximum(lower, nearest[cluster] / 2)))
    own = squares(points[at], centers.points[cluster[at]])
    taken = len(at)
    upper[at] = _up(np.sqrt(own.astype(np.float64)))
    open_ = ~(upper[at] < np.maximum(lower[at], nearest[cluster[at]] / 2))
    at, own = at[open_], own[open_]
    if k > 1 and len(at):
        start = cluster[at]
        radius = _up(2 * upper[at] + _up(_up(nearest[start])))
        inside = (centers.away[start] <= radius[:, None]).sum(axis=1)  # lists are sorted: so many from the front
        best, second, number = own, np.full(len(at), -1, dtype=np.int64), start.copy()
        for r in range(int(inside.max())):
            sub = np.flatnonzero(inside > r)
            j = centers.order[start[sub], r].astype(np.int32)
            _nearer(sub, squares(points[at[sub]], centers.points[j]), j, best, second, number)
            taken += len(sub)
        cluster[at] = number
        upper[at], lower[at] = _up(np.sqrt(best.astype(np.float64))), _down(np.sqrt(second.astype(np.float64)))
    return cluster, upper, lower, taken


def _points(column: pa.Array, size: int) -> np.ndarray:
    points = np.asarray(column.flatten()).reshape(-1, size)
    most = math.isqrt((1 << 63) // (4 * size)) - 1
    if len(points) and (int(points.max()) > most or int(points.min()) < -most):
        raise ValueError(f"components beyond {most} (after scaling): squared distances would not fit 64 bits")
    return points


def _assign(vectors: DataFrame, centers: Centroids, kind: T.DataType, known: bool) -> DataFrame:
    """Vectors with clusters and bounds; after a partition's vectors a row for each cluster it met, with sums and count."""
    k, size = centers.points.shape
    schema = T.StructType([T.StructField("vec_id", kind), *T._parse_datatype_string("point array<bigint>, cluster int, upper double, lower double, sums array<bigint>, members bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        trim()
        sums, members, kinds = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64), to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                points = _points(column["point"], size)
                if known:
                    bounds = (np.asarray(column[c]) for c in ("cluster", "upper", "lower"))
                    cluster, upper, lower, _ = exponion(points, *bounds, centers)
                else:
                    cluster, best, second = full_scan(points, centers)
                    upper = _up(np.sqrt(best.astype(np.float64)))
                    lower = np.where(second < 0, np.inf, _down(np.sqrt(np.maximum(second, 0).astype(np.float64))))
                for j in np.unique(cluster):
                    sums[j] += points[cluster == j].sum(axis=0)
                members += np.bincount(cluster, minlength=k)
                n = len(points)
                nothing = [pa.nulls(n, kinds.field(c).type) for c in ("sums", "members")]
                yield pa.RecordBatch.from_arrays([column["vec_id"], column["point"], pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), *nothing], schema=kinds)
        met = np.flatnonzero(members)
        if len(met):
            n = len(met)
            none = {c: pa.nulls(n, kinds.field(c).type) for c in ("vec_id", "point", "upper", "lower")}
            own = list_column(sums[met].ravel(), np.full(n, size), pa.int64())
            yield pa.RecordBatch.from_arrays([none["vec_id"], none["point"], pa.array(met, pa.int32()), none["upper"], none["lower"], own, pa.array(members[met])], schema=kinds)

    return vectors.mapInArrow(run, schema)


def _means(table: DataFrame, centers: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of sum / count; a centroid without vectors stays. (k times size numbers come to the driver.)"""
    rows = table.where("sums IS NOT NULL").select("cluster", "members", F.posexplode("sums").alias("axis", "value"))
    found = rows.groupBy("cluster", "axis").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("members").alias("members")).collect()
    out = [list(c) for c in centers]
    for r in found:
        out[r["cluster"]][r["axis"]] = int(r["value"]) // r["members"]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the least SHA-256 of ``seed:vec_id``, in this order; rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["point"]) for r in vectors.select(key.alias("key"), "point").orderBy("key", "point").limit(k).collect()]


def integer_vectors(rows: DataFrame, size: int, scale: int, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, point) of vectors of ``size`` components, none null, NaN or infinite; a component x is floor(scale * x)."""
    vector = F.col(column).cast("array<double>")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = rows.select(F.col(key).alias("vec_id"), vector.alias("vector")).where((F.size("vector") == size) & sound)
    return kept.select("vec_id", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x)).alias("point"))


def cluster_vectors(rows: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector, and the centroids after ``rounds`` rounds.

    Vectors with another number of components, with nulls or with numbers that are not finite are left out, so are
    null vectors. Repeated rows count each; a null vec_id takes part as an empty one. With fewer than k vectors there
    are as many centroids; with none, no rows. Other columns are not looked at. Components beyond 2^27 (at 64) fail,
    as their distances would not fit a long. Rounds that move nothing end the loop: all later ones would be the same.
    """
    vectors = integer_vectors(rows, size, scale, column, key)
    centers = first_centroids(vectors, k, seed)
    if not centers:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), []
    kind, table, before = vectors.schema["vec_id"].dataType, None, None
    for step in range(rounds + 1):
        source = vectors if table is None else table.where("point IS NOT NULL").select("vec_id", "point", "cluster", "upper", "lower")
        written = materialize(_assign(source, prepared(centers, before), kind, table is not None), "vectors")
        if table is not None:
            discard(table)
        table = written
        if step == rounds:
            break
        before, centers = centers, _means(table, centers)
        if before == centers:
            break
    return _distances(table.where("point IS NOT NULL").select("vec_id", "cluster", "point"), centers, kind), centers


def _distances(table: DataFrame, centers: list[list[int]], kind: T.DataType) -> DataFrame:
    points = np.array(centers, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                of = np.asarray(batch.column(1))
                gaps = squares(_points(batch.column(2), points.shape[1]), points[of])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gaps)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, T.StructType([T.StructField("vec_id", kind), *T._parse_datatype_string("cluster int, distance bigint").fields]))


def centroid_sha256(center: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()
