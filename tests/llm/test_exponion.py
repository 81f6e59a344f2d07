"""Centroid clustering against rounds of plain scans in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm.exponion import centroid_sha256, cluster_vectors, exponion, full_scan, prepared

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, point string"


def brute(rows, k, rounds, size, scale, seed="3"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [p for _, p in order[:k]]

    def near(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(near(p)[1], []).append(p)
        centers = [[sum(a) // len(groups[j]) for a in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    return sorted(((i, near(p)[1], near(p)[0]) for i, p in kept), key=str), centers


def run(spark, rows, **more):
    got, centers = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    return sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()), key=str), centers


@pytest.mark.parametrize("seed,size,k,scale", [(1, 2, 8, 4), (2, 3, 5, 2), (3, 2, 6, 1024), (4, 1, 4, 3)])
def test_equals_plain_rounds(spark, seed, size, k, scale):
    rng = random.Random(seed)
    few = [[rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(size)] for _ in range(12)]  # a coarse grid: many ties and repeats
    rows = [(i, rng.choice(few) if rng.random() < 0.6 else [float(np.float32(rng.gauss(0, 1))) for _ in range(size)], 0, "x", "y") for i in range(120)]
    assert run(spark, rows, k=k, rounds=6, size=size, scale=scale) == brute(rows, k, 6, size, scale)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], 0, "a", None), (1, [0.0, 1.0], 0, "a", None), (1, [5.0, 1.0], 0, "a", None), (None, [2.0, 2.0], None, None, None)]
    rows += [(2, None, 0, "", ""), (3, [], 0, "", ""), (4, [1.0], 0, "", ""), (5, [1.0, None], 0, "", ""), (6, [nan, 0.0], 0, "", ""), (7, [inf, 0.0], 0, "", ""), (8, [-inf, 0.0], 0, "", ""), (9, [1.0, 2.0, 3.0], 0, "", "")]
    got, centers = run(spark, rows, k=8, rounds=3, size=2, scale=2)
    assert (got, centers) == brute(rows, 8, 3, 2, 2)
    assert len(centers) == 4 and len(got) == 4 and [r[0] for r in got].count(1) == 3
    assert run(spark, [], k=8, size=2) == ([], [])
    assert run(spark, rows[4:], k=8, size=2) == ([], [])
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e30, 0.0], 0, "", "")], k=2, size=2)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(5)
    k, points = 40, np.concatenate([rng.normal(c, 30, (200, 4)) for c in rng.normal(0, 2000, (40, 4))]).astype(np.int64)
    centers = [list(map(int, p)) for p in points[rng.choice(len(points), k, replace=False)]]
    cluster, best, second = full_scan(points, prepared(centers, None))
    upper, lower, taken, rounds = np.sqrt(best) * (1 + 1e-14), np.sqrt(second) * (1 - 1e-14), 0, 0
    while True:
        before, centers = centers, [list(map(int, points[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()))) if (cluster == j).any() else c for j, c in enumerate(centers)]
        if before == centers:
            break
        now = prepared(centers, before)
        cluster, upper, lower, n = exponion(points, cluster, upper, lower, now)
        exact, best, second = full_scan(points, now)
        assert (cluster == exact).all() and (upper * upper >= best * (1 - 1e-12)).all() and (lower * lower <= second * (1 + 1e-12)).all()
        taken, rounds = taken + n, rounds + 1
    assert rounds > 2 and taken < 0.2 * rounds * len(points) * k


def test_digest():
    assert centroid_sha256([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()
