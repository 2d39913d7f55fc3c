"""Links and components against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from segmill.llm import embeddings
from tests.llm.test_simhash import _components


def _vectors(width, groups, size, noise, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.normal(size=width)
        out += [(centre + noise * rng.normal(size=width)).tolist() for _ in range(size)]
    return out


AWKWARD = [
    (None, 1), ([], 1), ([0.0] * 8, 1), ([1.0, None] + [0.0] * 6, 1), ([math.nan] * 8, 1), ([math.inf] + [0.0] * 7, 1),
    ([1.0] * 8, None), ([1.0] * 8, 1), ([1.0] * 8, 1), ([2.0] * 8, 1), ([1.0] * 8, 2), ([1.0] * 4, 1), ([1e300] * 8, 1),
]


def _expected(rows):
    good = {}
    for key, values, label in rows:
        if label is None or not values or None in values or not np.isfinite(values).all() or not any(values):
            continue
        x = np.array(values) / np.abs(values).max()
        good[key] = (label, x / np.linalg.norm(x))
    near = [
        (a, b) for a, (la, x) in good.items() for b, (lb, y) in good.items()
        if a != b and la == lb and len(x) == len(y) and x @ y >= 0.98
    ]
    least = _components([r[0] for r in rows], near)
    return {k: (sum(a == k for a, _ in near), c) for k, c in least.items()}


@pytest.mark.parametrize("block", [2048, 5])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BUCKET_ROWS", block)
    data = AWKWARD + [(x, 3) for x in _vectors(16, 12, 8, 0.08, 1)] + [(x, 4) for x in _vectors(8, 1, 60, 0.02, 2)]
    data += [(x, 5) for x in _vectors(64, 30, 4, 0.1, 3)]
    rows = [(1000 - k, x, label) for k, (x, label) in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS point", "2 AS links")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == _expected(rows)
    assert sum(n for n, _ in got.values()) > 1000
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_recall_of_candidate_pairs():
    """Pairs at the threshold itself, the hardest to find, meet in some bucket."""
    rng = np.random.default_rng(7)
    for width, least in ((8, 1.0), (16, 1.0), (64, 1.0), (128, 1.0), (300, 0.9995), (384, 0.9995), (768, 0.9985)):
        x = rng.normal(size=(2000, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * aside
        assert embeddings._meet(embeddings.nearest_axes(x), embeddings.nearest_axes(y)).any(1).mean() >= least


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3 + [(9, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    assert sorted(got) == [(1, 3, 1, True)] * 3 + [(9, 3, 1, False)]


def test_missing_ids_and_ids_with_several_vectors(spark):
    rows = [(None, [1.0, 2.0], 0), (None, None, 0), (4, [1.0, 2.0], 0), (7, [1.0, 2.01], 0), (4, [2.0, -1.0], 0), (9, [2.0, -1.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr)
    alone = [(None, 0, None, True)] * 2
    assert got == sorted([*alone, (4, 2, 4, True), (4, 2, 4, True), (7, 1, 4, False), (9, 1, 4, False)], key=repr)
