"""Language-model scoring by cross-entropy difference.

Two character n-gram models with the same order, smoothing and vocabulary are
counted, one on a target corpus and one on all documents (the background). A
document's score is the mean over its tokens of the target's loss less the
background's: the lower, the nearer to the target. Tokens are the lower-cased
characters and one end mark.

Documents are counted by blocks. A block sends each distinct n-gram once, with
its count; both models are tables over n-grams, and a block gets back the two
losses of its own n-grams only. Its text follows them by the block's key, a
hash of its content, so rows that changed between the two readings raise.

Smoothing interpolates relative frequencies of every order with the uniform
distribution over the shared vocabulary (Jelinek-Mercer, weights ``WEIGHTS``);
the weight of a context never seen goes to the uniform part.

Defined results: a null or empty text is one token, the end mark. Repeated rows
count and are scored once each; an empty table gives an empty result, and an
empty target gives the uniform model. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.llm.pretokens import code_points
from segmill.session import checkpointed

ORDER = 4
#: Weights of the orders 1 to 4; the rest is uniform.
WEIGHTS = (0.09, 0.2, 0.3, 0.4)
START, STOP = "\x02", "\x03"
#: A block ends at so many characters; texts are counted so many characters at a time.
BLOCK_CHARS, CHUNK = 16_000_000, 1 << 20
_SENT = 1 << 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _grams(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The padded texts in one string, the place of each token, and the hash of the n-gram that ends there."""
    whole = "".join(START * (ORDER - 1) + x + STOP for x in texts)
    points = code_points(whole).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
    token = np.ones(len(points), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER - 1):
        token[starts + k] = False
    mixed = np.zeros(len(points), np.uint64)
    for k in range(ORDER):
        mixed[ORDER - 1 :] ^= (points[ORDER - 1 - k : len(points) - k] + np.uint64(1)) * _ODD[k]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _ODD[-1]
    places = np.flatnonzero(token)
    return whole, places, mixed[places].view(np.int64)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Whole texts, about ``CHUNK`` characters at a time."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def _counts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts, their hashes and counts."""
    grams: dict[int, str] = {}
    sums = pd.Series(dtype=np.int64)
    for part in _parts(texts):
        whole, places, hashes = _grams(part)
        codes, found = pd.factorize(hashes)
        seen = np.empty(len(found), np.int64)
        seen[codes[::-1]] = places[::-1]
        for key, at in zip(found.tolist(), seen.tolist(), strict=True):
            if key not in grams:
                grams[key] = whole[at - ORDER + 1 : at + 1]
        sums = sums.add(pd.Series(np.bincount(codes, minlength=len(found)), found), fill_value=0)
    hashes = sums.index.to_numpy(np.int64)
    return [grams[k] for k in hashes.tolist()], hashes, sums.to_numpy(np.int64)


class _Block:
    def __init__(self) -> None:
        self.rows, self.texts, self.chars = [], [], 0

    def key(self) -> int:
        told = xxhash.xxh3_64(repr(self.rows).encode())
        for text in self.texts:
            told.update(text.encode("utf-8", "surrogatepass"))
            told.update(b"\xff")
        return told.intdigest() - (1 << 63)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for key, text in chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for b in batches):
        block.rows.append(key), block.texts.append((text or "").lower())
        block.chars += len(block.texts[-1]) + 1
        if block.chars >= BLOCK_CHARS:
            yield block
            block = _Block()
    if block.rows:
        yield block


def _gram_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        key, (grams, hashes, counts) = block.key(), _counts(block.texts)
        for at in range(0, len(grams), _SENT):
            part = slice(at, at + _SENT)
            columns = [pa.array(grams[part], pa.string()), pa.array(hashes[part]), pa.array(np.full(len(grams[part]), key)), pa.array(counts[part])]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "hash", "block", "n"])


def gram_rows(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``gram, hash, block, n``: the n-grams of each block of rows with their counts."""
    return df.select(doc_id.alias("doc_id"), text.cast("string").alias("text")).mapInArrow(
        _gram_rows, "gram string, hash long, block long, n long"
    )


def model_losses(target: DataFrame, background: DataFrame) -> DataFrame:
    """``gram, target_loss, background_loss`` of all n-grams of either corpus.

    Both arguments hold ``gram`` and ``n``. A loss is the negative logarithm of
    the probability of the n-gram's last character after the others.
    """
    counts = target.select("gram", F.col("n").alias("t"), F.lit(0).cast("long").alias("b")).unionByName(
        background.select("gram", F.lit(0).cast("long").alias("t"), F.col("n").alias("b"))
    )
    counts = checkpointed(counts.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
    totals = counts.agg(F.sum("t"), F.sum("b"), F.countDistinct(F.substring("gram", ORDER, 1))).first()
    total, letters = {"t": totals[0] or 0, "b": totals[1] or 0}, max(1, totals[2])
    rows, chance = counts, dict.fromkeys(("t", "b"), F.lit((1 - sum(WEIGHTS)) / letters))
    for order, weight in enumerate(WEIGHTS, 1):
        rows = _with_sums(rows, counts, ORDER - order + 1, order, f"s{order}")
        rows = _with_sums(rows, counts, ORDER - order + 1, order - 1, f"c{order}") if order > 1 else rows
        for side in ("t", "b"):
            whole = F.lit(total[side]) if order == 1 else F.col(f"c{order}_{side}")
            chance[side] += weight * F.when(whole > 0, F.col(f"s{order}_{side}") / whole).otherwise(F.lit(1 / letters))
    return rows.select("gram", (-F.log(chance["t"])).alias("target_loss"), (-F.log(chance["b"])).alias("background_loss"))


def _with_sums(rows: DataFrame, counts: DataFrame, start: int, size: int, name: str) -> DataFrame:
    """Add the counts of all n-grams that agree in ``size`` characters from ``start`` on.

    The sums are written, so Spark knows how small they are before it joins:
    one or two characters make a few thousand rows that many n-grams share.
    """
    if size == ORDER:
        return rows.withColumns({f"{name}_t": F.col("t"), f"{name}_b": F.col("b")})
    part = F.substring("gram", start, size)
    sums = counts.groupBy(part.alias("_part")).agg(F.sum("t").alias(f"{name}_t"), F.sum("b").alias(f"{name}_b"))
    return rows.withColumn("_part", part).join(checkpointed(sums), "_part").drop("_part")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_entropy, background_entropy, score`` of every row's whole text, in nats per token.

    ``target`` has a column ``text``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    arrow_kind = source.select("doc_id").limit(0).toArrow().schema.field(0).type

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            sizes = [len(x) for x in block.texts]
            packed = zstandard.compress("".join(block.texts).encode("utf-8", "surrogatepass"), 3)
            columns = [pa.array([block.key()]), pa.array([block.rows], pa.list_(arrow_kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "rows", "sizes", "texts"])

    def score(blocks: pa.Table, losses: pa.Table) -> pa.Table:
        hashes = losses["hash"].to_numpy()
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        both = np.stack([losses[x].to_numpy()[order] for x in ("target_loss", "background_loss")], 1)
        rows, sizes, sums = [], [], []
        for block in blocks.to_pylist():
            whole = zstandard.decompress(block["texts"]).decode("utf-8", "surrogatepass")
            ends = np.cumsum(block["sizes"]).tolist()
            held = [whole[end - size : end] for end, size in zip(ends, block["sizes"], strict=True)]
            for part in _parts(held):
                _, _, found = _grams(part)
                codes, distinct = pd.factorize(found)
                place = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
                if not len(hashes) or (hashes[place] != distinct).any():
                    raise RuntimeError("a block's rows changed between two readings of the input")
                lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
                sums.append(np.add.reduceat(both[place][codes], np.cumsum(lengths) - lengths, axis=0))
                sizes.append(lengths)
            rows += block["rows"]
        n, sums = np.concatenate(sizes), np.concatenate(sums)
        means = sums / n[:, None]
        columns = [pa.array(rows, arrow_kind), pa.array(n), pa.array(means[:, 0]), pa.array(means[:, 1]), pa.array(means[:, 0] - means[:, 1])]
        return pa.table(columns, ["doc_id", "n_tokens", "target_entropy", "background_entropy", "score"])

    found = gram_rows(source, F.col("doc_id"), F.col("text"))
    wanted = gram_rows(target, F.lit(0), F.col("text"))
    losses = checkpointed(model_losses(wanted, found))
    sent = found.select("gram", "hash", "block").join(losses, "gram").select("block", "hash", "target_loss", "background_loss")
    held = source.mapInArrow(texts, f"block long, rows array<{kind}>, sizes array<long>, texts binary")
    schema = f"doc_id {kind}, n_tokens long, target_entropy double, background_entropy double, score double"
    return held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(score, schema)
