"""Groups that may hold most of the rows: blocks of a group, and components of a graph."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.session import checkpointed

#: Hot nodes' edges are joined in so many parts.
SALTS = 16


def block_pairs(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Add ``pair``: every two rows of a group share at least one pair of blocks, and no pair holds many more than ``2 * size``.

    A group of at most ``size`` rows is one pair. A larger one is dealt to
    blocks by a hash of ``order``, and each row goes to the pairs of its block
    with every block of the group. ``rows`` is read twice; the list of large
    groups is written first, so Spark knows its size before it picks the join.
    """
    large = checkpointed(
        rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > size)
        .select(*keys, F.ceil(F.col("_rows") / size).cast("int").alias("_blocks"))
    )
    sized = rows.join(large, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    sized = sized.withColumn("_block", F.pmod(F.xxhash64(*order), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    sized = sized.withColumn("_other", other)
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return sized.withColumn("pair", F.struct(low.alias("low"), high.alias("high"))).drop("_blocks", "_other")


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of at least two rows among batches sorted by ``keys``, one table each."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        changed = np.zeros(max(0, rows.num_rows - 1), bool)
        for key in keys:
            column = rows[key].combine_chunks()
            changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.flatnonzero(changed) + 1))
        for k in np.flatnonzero(np.diff(bounds) > 1):
            yield rows.slice(bounds[k], bounds[k + 1] - bounds[k])
        held = rows.slice(bounds[-1])
    if held is not None and held.num_rows > 1:
        yield held


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to ``size - 1`` and links ``(a, b)``, each node's least reachable node."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, before[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            return root


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of all nodes of some undirected edges.

    Alternates two steps until nothing changes: every node's larger neighbours
    are linked to its least neighbour, then its smaller ones are. The number of
    rounds grows with the logarithm of the longest path. Each round's edges are
    written to the shared folder. A node's least neighbour is an aggregate
    combined before the shuffle; it returns to the edges by a join on node and
    salt, so that a hub's edges are spread.
    """

    def salted(neighbour: str) -> Column:
        return F.pmod(F.xxhash64(neighbour), F.lit(SALTS))

    def least(pairs: DataFrame) -> DataFrame:
        found = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def with_least(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("salt", salted("v")).join(least(pairs), ["u", "salt"]).drop("salt")

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        kept = checkpointed(pairs.where("u <> v").distinct())
        return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, told = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while told[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        small = with_least(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        before = told
        now, told = written(linked.unionByName(own))
        if told == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
