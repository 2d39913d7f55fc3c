"""Codes against plain rounds over all distances, and what the kept bounds may and do exclude."""

from __future__ import annotations

import math

import numpy as np
import pytest

from segmill.llm import vector_codes
from segmill.llm.integers import SLACK, squared
from segmill.llm.vector_codes import compress, search_all, search_near, with_label_error


def _expected(rows, parts, entries, rounds, scale, width):
    kept = []
    for key, x, label in rows:
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x):
            kept.append((key, label, [math.floor(v * scale) for v in x]))
    size = width // parts
    cut = lambda v, p: v[p * size : p * size + size]
    first = sorted(kept, key=lambda row: (row[0] is None, row[0] or 0, row[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        best = [[min((far(cut(v, p), c), n) for n, c in enumerate(books[p])) for p in range(parts)] for _, _, v in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for n in range(len(books[p])):
                mine = [cut(v, p) for (_, _, v), own in zip(kept, best, strict=True) if own[p][1] == n]
                if mine:
                    books[p][n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors = [sum(d for d, _ in own) for own in best]
    by_label = {}
    for (_, label, _), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    out = [(key, bytes(n for _, n in own), e, by_label[label]) for (key, label, _), own, e in zip(kept, best, errors, strict=True)]
    return sorted(out, key=repr), books


def _vectors(seed, groups, size, width, noise):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=width) + noise * rng.normal(size=(size, width)) for _ in range(groups)])


AWKWARD = [
    (None, None, 1), (None, [1.0] * 8, None), (1, None, 1), (2, [], 1), (3, [1.0, None] + [0.0] * 6, 1), (4, [math.nan] * 8, 1),
    (5, [-math.inf] + [0.0] * 7, 1), (6, [0.5] * 7, 1), (7, [0.5] * 4, None), (8, [0.0] * 8, None), (9, [0.0] * 8, 2), (9, [0.0] * 8, 2),
    (10, [100.25] * 8, 2), (11, [-100.3] * 8, None),
]


@pytest.mark.parametrize("entries,kept", [(1, 32), (2, 32), (16, 5), (40, 32), (256, 3)])
def test_against_plain_rounds(spark, monkeypatch, entries, kept):
    monkeypatch.setattr(vector_codes, "KEPT", kept)
    monkeypatch.setattr(vector_codes, "LEAST", 2)
    rows = AWKWARD + [(500 - j, x.tolist(), j % 3 or None) for j, x in enumerate(_vectors(1, 10, 12, 8, 0.3))]
    rows += [(600 + j, [float(j % 4), 0.0] * 4, 7) for j in range(20)]  # ties and equal vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.selectExpr("*", "1 AS code", "2 AS error", "3 AS bounds", "4 AS label_error")
    found, books = compress(df, entries=entries, rounds=4)
    got = sorted(((r.vec_id, bytes(r.code), r.error, r.label_error) for r in with_label_error(found).collect()), key=repr)
    expected, expected_books = _expected(rows, 4, entries, 4, 1024, 8)
    assert got == expected and books.tolist() == expected_books


def test_empty_lengths_and_too_large(spark):
    df = spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id long, embedding array<float>, label int")
    assert compress(df.where("false"))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        compress(df)
    huge = spark.createDataFrame([(1, [1e12] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="do not fit"):
        compress(huge)


@pytest.mark.parametrize("kept", [1, 6, 40])
def test_bounds_hold_and_decide_over_many_moves(kept):
    """Through random moves of the codebook every bound stays below the distances it speaks of, and entries stay nearest."""
    rng = np.random.default_rng(kept)
    part = np.floor(1024 * _vectors(2, 20, 30, 16, 0.3)).astype(np.int64)
    book = part[rng.choice(len(part), 64, replace=False)]
    code, near, bounds = search_all(part, book, kept)
    for turn in range(6):
        step = np.where(rng.random((64, 1)) < 0.3, rng.integers(-300 // (turn + 1), 300 // (turn + 1) + 1, (64, 16)), 0)
        old, book = book, book + step
        moved = np.sqrt(squared(old, book).astype(float)) * (1 + SLACK)
        near, bounds = vector_codes._cut(near, bounds, kept)
        code, near, bounds, doubts = search_near(part, book, moved, code, near, bounds)
        every = ((part[:, None] - book) ** 2).sum(2)
        assert (code == every.argmin(1)).all()
        away = np.sqrt(every)
        lower = vector_codes._ordered(bounds)
        listed = np.zeros(every.shape, bool)
        listed[np.arange(len(part)), code] = True
        for k in range(kept):
            assert (lower[:, k] <= away[np.arange(len(part)), near[:, k]] + 1e-9).all()
            listed[np.arange(len(part)), near[:, k]] = True
        if not listed.all():
            assert (lower[:, kept] <= np.where(listed, np.inf, away).min(1) + 1e-9).all()
    assert (doubts == 0).any()  # small moves leave most parts decided


def test_the_list_adapts():
    counts = {0: 70, 1: 20, 3: 6, 20: 4}
    assert vector_codes._adapted(counts, 32) == max(vector_codes.LEAST, 3)
    assert vector_codes._adapted({33: 100}, 32) == 32 and vector_codes._adapted({0: 5}, 2) == 2
