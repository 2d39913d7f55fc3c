"""Near-copies by the Jaccard similarity of their word shingles: MinHash bands find pairs, the shingles decide.

A text's shingles are the distinct runs of ``WIDTH`` words (lower-cased bytes; a
shorter text is one shingle). Texts with the same shingles are one point. Each
of ``BANDS`` keys is made of ``ROWS`` least hashes, so two texts of similarity
``s`` share a key with chance ``1 - (1 - s ** ROWS) ** BANDS``: all but 7 in a
million pairs at the threshold itself. The true shingles of every pair that is
linked are compared.

Pairs that share a key are compared in rounds: first every point with a centre
of its bucket, with another centre in each round, then all rows of each bucket
that holds several components yet, in blocks that hand on spanning stars. Nothing
that shares a key is left undecided. A bucket of n texts that are alike but not
near-copies still costs about n squared comparisons.

Defined results: a null text or one without words equals any other such text.
Rows with a null id are linked with nothing and all stay. Repeated rows are one.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm.groups import SALTS, block_pairs, connected, roots
from segmill.session import checkpointed

WIDTH = 5
#: Pairs of at least ``NEAR[0] / NEAR[1]`` are near-copies.
NEAR = (4, 5)
BANDS, ROWS = 30, 5
#: Rounds of comparisons with one centre a bucket before all pairs that are left.
ROUNDS = 2
#: Rows of a bucket that one task compares with each other, and rows that a task sends on at once.
BUCKET_ROWS, SENT = 1000, 500
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes (XXH64, seed 42) of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, at, starts = b" ".join(words), 0, [0]
    for word in words:
        at += len(word) + 1
        starts.append(at)
    hashed, count = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    ends = starts[min(width, len(words)) :]
    return np.unique(np.fromiter((hashed(joined[a : b - 1], 42) for a, b in zip(starts[:count], ends, strict=False)), np.uint64, count))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band; two texts that agree in a band's least hashes share its key."""
    if not len(found):
        return []
    least = np.array([((found ^ flip) * odd).min() for flip, odd in zip(_FLIP, _ODD, strict=True)], np.uint64)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row with an id: ``doc_id``, ``told`` (its text's hash), ``mark`` (its shingles' hash), their number and band keys."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SENT):
                part, told = batch.slice(at, SENT), []
                for text in part.column(2):  # a text's shingles go before the next one's come
                    found = shingles(text.as_py())
                    told.append((xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63), len(found), band_keys(found)))
                marks, sizes, keys = zip(*told, strict=True)
                columns = [part.column(0), part.column(1), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "told", "mark", "size", "keys"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), _told(text).alias("told"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, told long, mark long, size long, keys array<long>")


def _told(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _with_text(pairs: DataFrame, side: str, other: str, texts: DataFrame) -> DataFrame:
    """Add ``text_<side>``; a point of many pairs is spread by a salt."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    wanted = salted.select(side, "_salt").distinct().join(texts.select(F.col("mark").alias(side), F.col("text").alias(f"text_{side}")), side)
    return salted.join(wanted, [side, "_salt"]).drop("_salt")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose texts are near-copies."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(8)(shingles)
        for batch in batches:
            kept = [near(known(x.as_py()), known(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = _with_text(_with_text(pairs, "a", "b", texts), "b", "a", texts)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(each, "a long, b long")


def _components(spots: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``node, component`` of linked points; ``spots`` holds ``key, mark, size`` of buckets of several points."""
    labels = tested = None
    many, few = (NEAR[1], NEAR[0])
    for turn in range(ROUNDS + 1):
        if labels is None:
            now = spots.withColumn("component", F.col("mark"))
        else:
            named = spots.join(labels, F.col("mark") == F.col("node"), "left")
            now = checkpointed(named.select("key", "mark", "size", F.coalesce("component", "mark").alias("component")))
        if turn == ROUNDS:
            links = checkpointed(_links_left(now, texts))
            return labels if links.isEmpty() else _joined(links, labels)
        best = F.min_by(F.struct("mark", "size", "component"), F.xxhash64("mark", F.lit(turn)))
        met = now.join(checkpointed(now.groupBy("key").agg(best.alias("c"))), "key").select(
            "mark", "size", "component", F.col("c.mark").alias("mark2"), F.col("c.size").alias("size2"), F.col("c.component").alias("component2")
        )
        sized = (many * F.least("size", "size2") >= few * F.greatest("size", "size2")) & (F.col("component") != F.col("component2"))
        pairs = met.where(sized).select(F.least("mark", "mark2").alias("a"), F.greatest("mark", "mark2").alias("b")).distinct()
        pairs = checkpointed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = checkpointed(_verified(pairs, texts))
        if not links.isEmpty():
            labels = _joined(links, labels)


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    old = links.limit(0) if labels is None else labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return checkpointed(connected(links.unionByName(old), "a", "b"))


def _links_in_bucket(rows: pa.Table) -> pa.Table:
    """A spanning star of the near-copies among a bucket's rows, which meet by an index of their shingles."""
    order = np.argsort(rows["mark"].to_numpy(), kind="stable")
    marks = rows["mark"].to_numpy()[order]
    sets = [shingles(rows["text"][int(k)].as_py()) for k in order]
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    held = np.bincount(codes)
    starts = np.cumsum(held) - held
    a, b = [], []
    for k, end in enumerate(ends):
        mine = codes[end - sizes[k] : end]
        places = np.repeat(starts[mine] - (np.cumsum(held[mine]) - held[mine]), held[mine]) + np.arange(held[mine].sum())
        both = np.bincount(owners[places], minlength=len(sets))
        other = np.flatnonzero(NEAR[1] * both >= NEAR[0] * (sizes[k] + sizes - both))
        a.append(np.full(len(other), k)), b.append(other)
    root = roots(len(sets), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(root != np.arange(len(sets)))
    return pa.table([pa.array(marks[linked]), pa.array(marks[root[linked]])], ["a", "b"])


def _links_left(now: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` within the buckets that hold several components; a large bucket is compared in pairs of blocks."""
    mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    held = checkpointed(now.join(checkpointed(mixed), "key").select("key", "mark"))
    paired = block_pairs(held, ["key"], ["mark"], BUCKET_ROWS).select("key", "pair", "mark").join(texts, "mark")
    return paired.groupBy("key", "pair").applyInArrow(_links_in_bucket, "a long, b long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near-copies: the one with the least id; rows with a null id all stay."""
    signed = checkpointed(_signed(docs, doc_id, text))
    points = checkpointed(signed.groupBy("mark").agg(F.min(F.struct("doc_id", "told")).alias("one"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    spots = points.select(F.explode("keys").alias("key"), "mark", "size")
    shared = checkpointed(spots.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("key"))
    spots = checkpointed(spots.join(shared, "key"))
    wanted = checkpointed(points.join(spots.select("mark").distinct(), "mark", "left_semi").select("mark", "one.doc_id", "one.told"))
    named = docs.select(F.col(doc_id).alias("doc_id"), _told(text).alias("told"), F.col(text).cast("string").alias("text"))
    texts = checkpointed(wanted.join(named, ["doc_id", "told"]).groupBy("mark").agg(F.first("text").alias("text")))
    labels = _components(spots, texts)
    if labels is not None:
        points = points.join(labels, F.col("mark") == F.col("node"), "left").withColumn("mark", F.coalesce("component", "mark"))
    kept = points.groupBy("mark").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("_kept"), F.col("one.told").alias("_told"))
    kept = checkpointed(kept)
    same = (F.col(doc_id) == F.col("_kept")) & (_told(text) == F.col("_told"))
    named = docs.join(kept, same, "left_semi").withColumn("_told", _told(text))
    first = F.row_number().over(Window.partitionBy(doc_id, "_told").orderBy(F.lit(0)))
    one = named.withColumn("_first", first).where("_first = 1").drop("_first", "_told")
    return one.unionByName(docs.where(F.col(doc_id).isNull()))
