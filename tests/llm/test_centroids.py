"""Clusters against plain rounds over all distances, and what the pivot bounds may and do exclude."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from segmill.llm import centroids
from segmill.llm.centroids import PIVOTS, Pivots, cluster, nearest, with_inertia


def _groups(seed, groups, size, width, noise):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=width) + noise * rng.normal(size=(size, width)) for _ in range(groups)])


def _expected(rows, k, rounds, scale, width):
    """Plain Python integers; rows are (vec_id, vector)."""
    kept = []
    for key, x in rows:
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x):
            kept.append((key, [math.floor(v * scale) for v in x]))
    rank = lambda row: (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])
    centres = [v for _, v in sorted(kept, key=rank)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        best = [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn == rounds:
            break
        for n in range(len(centres)):
            mine = [v for (_, v), (_, own) in zip(kept, best, strict=True) if own == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = [0] * len(centres)
    for d, n in best:
        inertia[n] += d
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, n, d, inertia[n], sum(inertia), told[n]) for (key, _), (d, n) in zip(kept, best, strict=True)), key=repr)


AWKWARD = [
    (None, None), (None, [1.0] * 8), (1, None), (2, []), (3, [1.0, None] + [0.0] * 6), (4, [math.nan] * 8), (5, [math.inf] + [0.0] * 7),
    (6, [0.5] * 7), (7, [0.5] * 9), (8, [0.0] * 8), (9, [-0.0] * 8), (9, [-0.0] * 8), (10, [1000.25] * 8), (11, [-1000.3] * 8),
]


@pytest.mark.parametrize("k", [1, 3, 12, 500])
def test_against_plain_rounds(spark, k):
    rows = AWKWARD + [(100 - j, x.tolist()) for j, x in enumerate(_groups(1, 6, 20, 8, 0.2))]
    rows += [(300 + j, [float(j % 3)] * 8) for j in range(30)]  # ties and equal vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS inertia")
    got = with_inertia(*cluster(df, k=k, rounds=5, scale=256, width=8))
    assert sorted(map(tuple, got.collect()), key=repr) == _expected(rows, k, 5, 256, 8)


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>")
    empty = with_inertia(*cluster(df.where("false")))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="do not fit"):
        cluster(df)[0].collect()


@pytest.mark.parametrize("noise,most", [(0.05, 0.2), (1.0, 1.0)])
def test_bounds_exclude_no_nearest_centroid(noise, most):
    rows = np.floor(256 * _groups(3, 40, 50, 64, noise)).astype(np.int64)
    first = rows[::50].copy()
    pivots = Pivots(first)
    assert len(pivots.points) == PIVOTS and len(pivots.pairs) == PIVOTS * (PIVOTS - 1) // 2
    best, distance, computed = nearest(rows, pivots.distances(rows), first, pivots)
    every = ((rows[:, None] - first) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert computed <= most * every.size + len(rows)  # groups apart: most distances are not computed


def test_bounds_hold_where_distances_are_equal():
    """Vectors on a line through the pivots reach the bound itself; large components leave no room for rounding."""
    for scale in (1, 10**6):
        rows = np.arange(-60, 60)[:, None] * np.full((1, 16), scale)
        first = rows[[0, 40, 80, 119, 60, 61]].astype(np.int64)
        pivots = Pivots(first)
        best, distance, _ = nearest(rows, pivots.distances(rows), first, pivots)
        every = ((rows[:, None] - first) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_more_partitions_and_lost_order_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 7)
    rows = [(j, x.tolist()) for j, x in enumerate(_groups(5, 5, 30, 64, 0.4))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    results = [sorted(map(tuple, cluster(df.repartition(n), k=7)[0].collect())) for n in (1, 9)]
    assert results[0] == results[1]
