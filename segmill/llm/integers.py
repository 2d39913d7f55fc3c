"""Vectors as integers, exact squared distances, and roots that err to a known side."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More than the relative error of a few operations in double precision.
SLACK = 2.0**-48


def usable(vector: str, width: int | None = None) -> Column:
    """Whether a vector is there, without null or non-finite components, and has ``width`` of them if that is given."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(good if width is None else good & (F.size(vector) == width), F.lit(False))


def floors(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def limit(width: int) -> int:
    """The largest component whose squared distances over ``width`` components fit 64 bits."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // max(1, width)) // 2)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` integers as rows of 32-bit numbers."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    if rows.size and max(abs(int(rows.min())), abs(int(rows.max()))) > limit(width):
        raise ValueError(f"components beyond {limit(width)} after scaling do not fit exact distances in 64 bits")
    return rows.astype("<i4")


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.array([x.tobytes() for x in rows], pa.binary()) if rows.size else pa.array([b""] * len(rows), pa.binary())


def unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    apart = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", apart, apart)


def squared_to_all(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: in double precision where every term is an integer it can hold."""
    rows, entries = rows.astype(np.int64), entries.astype(np.int64)
    most = rows.shape[1] * max(1, int(np.abs(rows).max(initial=0))) * max(1, int(np.abs(entries).max(initial=0)))
    product = (rows.astype(float) @ entries.T.astype(float)).astype(np.int64) if most < 2**53 else rows @ entries.T
    return (rows * rows).sum(1)[:, None] - 2 * product + (entries * entries).sum(1)


def means(rows: DataFrame, keys: list[str], old: np.ndarray) -> np.ndarray:
    """``old`` with each entry replaced by its componentwise ``floor(sum / count)``.

    ``rows`` holds the entry's indexes ``keys``, ``place`` (of the component),
    ``total`` and ``count``: partial sums, one set a task.
    """
    new = old.copy()
    for row in rows.groupBy(*keys, "place").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect():
        new[(*[row[x] for x in keys], row["place"])] = row["total"] // row["count"]
    return new


def digest(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()
