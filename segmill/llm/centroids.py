"""Centroid clustering of integer vectors with Ptolemaic pivots.

For pivots ``p, s``, a vector ``x`` and a centroid ``c``, Ptolemy's inequality
gives ``d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|``. The pivots
are some of the first centroids and stay fixed, so a vector's distances to them
are computed once and written beside it. In a round the centroids' distances to
the pivots are all that is needed to bound every vector's distance to every
centroid from below: a centroid whose bound exceeds the exact distance to
another one cannot be nearest. Bounds are rounded to the safe side, and all
centroids that they leave are compared by exact integer distances.

Each round reads the written vectors once. A task adds up its vectors by
centroid, so what is shuffled and comes to the driver has a row for each
centroid and component, whatever the number of vectors or their spread.

Defined results: only vectors of ``width`` components, none null or non-finite,
take part and come out. Equal ids are vectors of their own. Null ids come last
in the order of the first centroids. With fewer than ``k`` vectors there are as
many centroids as vectors; an empty table gives an empty result. Components so
large that squared distances leave 64 bits raise an error. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.integers import SLACK, digest, floors, matrix, means, packed, squared, squared_to_all, unpacked, usable
from segmill.session import checkpointed

PIVOTS = 8
#: Pivot pairs that bound every centroid; the others only bound the centroids these leave.
FIRST_PAIRS = 6
#: Vectors compared at once.
ROWS = 2048


class Pivots:
    """Some of the first centroids, far from each other, and their pairs."""

    def __init__(self, first: np.ndarray) -> None:
        chosen, nearest = [0], squared(first, first[:1])
        while len(chosen) < PIVOTS and nearest.max() > 0:  # the farthest from those chosen so far
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(first, first[chosen[-1:]]))
        self.points = first[chosen]
        between = self.distances(self.points)
        pairs = [(i, j) for j in range(len(chosen)) for i in range(j)]
        self.pairs = [(i, j, between[i, j] * (1 + SLACK)) for i, j in sorted(pairs, key=lambda x: -between[x])]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(squared_to_all(rows, self.points).astype(float))

    def bound(self, pair: tuple[int, int, float], x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Lower bounds from distances to the pivots (last axis) of vectors and centroids."""
        i, j, between = pair
        one, two = x[..., i] * c[..., j], x[..., j] * c[..., i]
        return (np.abs(one - two) - (one + two) * SLACK) / between


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed."""
    known = pivots.distances(centroids)
    lower = np.zeros((len(rows), len(centroids)))
    for pair in pivots.pairs[:FIRST_PAIRS]:
        np.maximum(lower, pivots.bound(pair, to_pivots[:, None], known[None]), out=lower)
    guess = lower.argmin(1)
    upper = np.sqrt(squared(rows, centroids[guess]).astype(float)) * (1 + SLACK)
    row, entry = np.nonzero(lower * (1 - SLACK) <= upper[:, None])
    for pair in pivots.pairs[FIRST_PAIRS:]:
        left = pivots.bound(pair, to_pivots[row], known[entry]) * (1 - SLACK) <= upper[row]
        row, entry = row[left], entry[left]
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[row[part], entry[part]] = squared(rows[row[part]], centroids[entry[part]])
    best = exact.argmin(1)
    return best, exact[np.arange(len(rows)), best], len(row) + len(rows)


def _assigned(batches: Iterable[pa.RecordBatch], centroids: np.ndarray, pivots: Pivots) -> Iterator[tuple]:
    width, many = centroids.shape[1], len(pivots.points)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = unpacked(part.column("vector"), "<i4", width)
            yield part, rows, *nearest(rows, unpacked(part.column("pivots"), "<f8", many), centroids, pivots)[:2]


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, salt: str = "2:", vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of every vector that takes part, and the centroids.

    Components are ``floor(scale * x)``. The first centroids are the ``k``
    vectors with the least SHA-256 of ``salt`` and id; every round assigns all
    vectors and moves each centroid to the componentwise floor of the mean.
    """
    kept = df.where(usable(embedding, width)).select(F.col(vec_id).alias("vec_id"), floors(embedding, scale).alias("parts"))
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    least = kept.orderBy(rank.asc_nulls_last(), "parts").limit(k).select("parts").toArrow()
    first = matrix(least.column(0).combine_chunks(), width).astype(np.int64)
    if not len(first):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), first
    pivots = Pivots(first)

    def prepared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("parts"), width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(rows), packed(pivots.distances(rows))], ["vec_id", "vector", "pivots"])

    id_kind = df.schema[vec_id].dataType.simpleString()
    points = checkpointed(kept.mapInArrow(prepared, f"vec_id {id_kind}, vector binary, pivots binary"))
    centroids = first
    for _ in range(rounds):
        centroids = means(points.select("vector", "pivots").mapInArrow(_sums(centroids, pivots), "cluster int, place int, total long, count long"), ["cluster"], centroids)
    last = centroids

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, distance in _assigned(batches, last, pivots):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return points.mapInArrow(finished, f"vec_id {id_kind}, cluster int, distance long"), last


def _sums(centroids: np.ndarray, pivots: Pivots):
    """The sums and counts of a task's vectors by centroid."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, rows, best, _ in _assigned(batches, centroids, pivots):
            np.add.at(totals, best, rows)
            counts += np.bincount(best, minlength=len(counts))
        some = np.flatnonzero(counts)
        columns = [np.repeat(some, totals.shape[1]).astype(np.int32), np.tile(np.arange(totals.shape[1], dtype=np.int32), len(some))]
        columns += [totals[some].ravel(), np.repeat(counts[some], totals.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cluster", "place", "total", "count"])

    return each


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; the table of clusters has a row for each centroid."""
    found = checkpointed(found)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row[0]: int(row[1]) for row in found.groupBy("cluster").agg(wide).collect()}
    rows = [(number, total, sum(sums.values()), digest(centroids[number])) for number, total in sorted(sums.items())]
    clusters = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
