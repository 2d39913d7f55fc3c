"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, with verified pairs.

A hash rotates a vector by three rounds of random signs and a Hadamard
transform and takes the axis it lies nearest to; a bucket joins ``HASHES`` such
axes. Every vector lives in one bucket of each of ``TABLES`` tables and probes
the buckets got by its second-nearest axes. Ids come first: only places in
buckets that hold a resident and another vector are sent the vector itself.
Within a bucket all pairs are verified by cosine in double precision, in pairs
of blocks if the bucket is large. A pair that meets in several tables counts in
the first, which both vectors' axes tell.

Defined results: vectors that are null, zero, or hold null or non-finite
numbers, and those with a null label or id, link with nothing. Vectors of different
lengths link with nothing either. Equal vectors of one label are one class and
link with each other; repeated rows are vectors of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.groups import block_pairs, connected, roots, runs_of
from segmill.session import checkpointed

TABLES, HASHES = 9, 3
#: Rows of a bucket that one task compares with each other.
BUCKET_ROWS = 512


def _size(width: int) -> int:
    """The power of two that vectors are padded to."""
    return 1 << max(1, (width - 1).bit_length())


def _axis_type(width: int) -> np.dtype:
    return np.dtype("<u2" if _size(width) <= 1 << 15 else "<u4")


@cache
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng(size).choice([-1.0, 1.0], (TABLES, HASHES, 3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, in ``log2`` steps of sums and differences."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return x / np.sqrt(size)


def nearest_axes(vectors: np.ndarray) -> np.ndarray:
    """For each vector, table and hash the nearest and second-nearest signed axis: an array (rows, TABLES, HASHES, 2)."""
    rows, width = vectors.shape
    size = _size(width)
    padded = np.zeros((rows, size))
    padded[:, :width] = vectors
    out = np.empty((rows, TABLES, HASHES, 2), _axis_type(width))
    for table in range(TABLES):
        for k in range(HASHES):
            x = padded
            for signs in _signs(size)[table, k]:
                x = _hadamard(x * signs)
            order = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            best = np.take_along_axis(x, order, 1)
            swap = np.abs(best[:, 0]) < np.abs(best[:, 1])
            order[swap], best[swap] = order[swap][:, ::-1], best[swap][:, ::-1]
            out[:, table, k] = 2 * order + (best < 0)
    return out


def buckets(axes: np.ndarray, width: int) -> np.ndarray:
    """For each vector and table its own bucket and the probed ones: an array (rows, TABLES, 1 + HASHES)."""
    axes = axes.astype(np.int64)
    first, second = axes[..., 0], axes[..., 1]
    out = np.empty((*first.shape[:2], 1 + HASHES), np.int64)
    weights = (2 * _size(width)) ** np.arange(HASHES)
    out[:, :, 0] = first @ weights
    for k in range(HASHES):  # the second-nearest axis of one hash at a time
        out[:, :, 1 + k] = out[:, :, 0] + (second[:, :, k] - first[:, :, k]) * weights[k]
    return out


def _can_link(values: list | None) -> bool:
    return bool(values) and None not in values and bool(np.isfinite(values).all()) and any(values)


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one width as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _numbers(df: DataFrame, embedding: str) -> str:
    """How a vector's numbers travel: single precision if they come so, else double."""
    return "<f4" if df.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"


def classes(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, and for vectors that can link their ``class_key``, ``label``, ``width`` and ``vector`` (the numbers' bytes)."""
    numbers = _numbers(df, embedding)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths, vectors = [], [], []
            for values, mark in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array(values, numbers).tobytes() if mark is not None and _can_link(values) else None
                vectors.append(x)
                widths.append(None if x is None else len(values))
                keys.append(None if x is None else xxhash.xxh128_hexdigest(f"{mark}/".encode() + x))
            columns = [batch.column(0), batch.column(2), pa.array(keys, pa.string()), pa.array(widths, pa.int64()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "class_key", "width", "vector"])

    kinds = [df.schema[x].dataType.simpleString() for x in (vec_id, label)]
    rows = df.select(F.col(vec_id).alias("vec_id"), F.when(F.col(vec_id).isNotNull(), F.col(embedding)).alias("embedding"), F.col(label).alias("label"))
    return rows.mapInArrow(each, f"vec_id {kinds[0]}, label {kinds[1]}, class_key string, width long, vector binary")


def _hashed(points: DataFrame, numbers: str) -> DataFrame:
    """Add ``axes`` (bytes) and ``buckets``, ``1 + HASHES`` a table, to classes."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                axes = nearest_axes(_units(part.column("vector").to_pylist(), numbers))
                found = buckets(axes, int(width)).reshape(len(axes), -1)
                columns = [*part.columns, pa.array([x.tobytes() for x in axes], pa.binary()), pa.array(list(found), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "axes", "buckets"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(each, fields + ", axes binary, buckets array<long>")


def _shared_places(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """``point``, ``key``, ``home`` and ``keys`` of the places in buckets where a pair can meet."""
    places = hashed.select("label", "width", "point", "key", F.posexplode("buckets").alias("_at", "bucket"))
    places = places.select(
        "point",
        "key",
        (F.col("_at") % (1 + HASHES) == 0).alias("home"),
        "label",
        "width",
        F.floor(F.col("_at") / (1 + HASHES)).cast("int").alias("table"),
        "bucket",
    )
    shared = places.groupBy(*keys).agg(F.count("*").alias("_rows"), F.max("home").alias("_lived")).where("_rows > 1 AND _lived")
    return places.join(checkpointed(shared.select(*keys)), keys)


def _covers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b`` lives in or probes ``a``'s own bucket, from axes (..., HASHES, 2)."""
    same = a[..., 0] == b[..., 0]
    return (same | (a[..., 0] == b[..., 1])).all(-1) & ((~same).sum(-1) <= 1)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether vectors meet in some bucket of a table."""
    return _covers(a, b) | _covers(b, a)


def _links_in_bucket(threshold: float, keys: list[str], numbers: str):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, keys):
            if rows["home"].to_numpy().any() and (found := links_of(rows)).num_rows:
                yield found

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        point, copies, home, block = (rows[x].to_numpy() for x in ("point", "copies", "home", "_block"))
        table = rows["table"][0].as_py()
        apart = rows["low"][0].as_py() != rows["high"][0].as_py()
        vectors = _units(rows["vector"].to_pylist(), numbers)
        axes = np.frombuffer(b"".join(rows["axes"].to_pylist()), _axis_type(vectors.shape[1])).reshape(len(point), TABLES, HASHES, 2)
        residents, links = np.flatnonzero(home), np.zeros(len(point), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, 1_000_000 // max(1, len(residents)))
        for k in range(0, len(point), step):
            i, j = np.nonzero(vectors[k : k + step] @ vectors[residents].T >= threshold)
            i, j = i + k, residents[j]
            fit = (point[i] < point[j]) | (~home[i] & ~_covers(axes[i, table], axes[j, table]))
            fit &= (point[i] != point[j]) & ((block[i] != block[j]) | (not apart))
            i, j = i[fit], j[fit]
            first = ~_meet(axes[i, :table], axes[j, :table]).any(1)
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            ends.append((i, j))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        order = np.argsort(point, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = order[roots(len(point), rank[a], rank[b])[rank]]
        some = np.flatnonzero(links)
        columns = [pa.array(point[some]), pa.array(links[some]), pa.array(point[root[some]])]
        return pa.RecordBatch.from_arrays(columns, ["point", "links", "root"])

    return each


def near_duplicates(
    df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; links join vectors of one label with cosine >= ``threshold``."""
    every = checkpointed(classes(df, vec_id, embedding, label))
    points = checkpointed(
        every.where("class_key IS NOT NULL").groupBy("class_key")
        .agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("width").alias("width"), F.first("vector").alias("vector"))
    )
    numbers = _numbers(df, embedding)
    # an id may come with several vectors, so a class is told by its key as well
    hashed = checkpointed(_hashed(points.withColumn("key", F.xxhash64("class_key")).drop("class_key"), numbers))
    keys = ["label", "width", "table", "bucket"]
    places = checkpointed(_shared_places(hashed, keys))
    rows = block_pairs(places, keys, ["point"], BUCKET_ROWS).select("*", "pair.*").drop("pair")
    rows = rows.join(hashed.select("point", "key", "copies", "vector", "axes"), ["point", "key"])
    keys = [*keys, "low", "high"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = checkpointed(rows.mapInArrow(_links_in_bucket(threshold, keys, numbers), "point long, links long, root long"))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    parts = connected(found.where("point <> root").select("point", "root"), "point", "root")
    named = points.select("class_key", "point", "copies").join(links, "point", "left").join(parts, F.col("point") == F.col("node"), "left")
    named = checkpointed(
        named.select("class_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    )
    linked = every.where("class_key IS NOT NULL").select("vec_id", "class_key").join(named, "class_key").drop("class_key")
    alone = every.where("class_key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
