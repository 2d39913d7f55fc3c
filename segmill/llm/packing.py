"""Packing token sequences into windows by best-fit decreasing.

``token_pieces`` encodes documents and cuts overlong ones into full windows and
a rest. ``pack`` places any table of pieces: best-fit decreasing only asks how
many pieces there are of each length, so Spark counts the lengths, the driver
packs the counts (a histogram of at most ``window`` rows, whatever the corpus),
and every piece takes the place its rank within its length has.

Defined results: a null or empty text is one piece, the closing id alone.
Repeated rows and equal lengths are pieces of their own, ranked by the order
columns; equal rows may change places. An empty table gives an empty result.
Other columns, whatever their names, are ignored by ``token_pieces`` and
carried by ``pack``, which uses its own ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm.pretokens import chunks
from segmill.llm.vocabularies import piece_encoder, segments
from segmill.session import checkpointed

#: Piece groups per length: a length that holds most of the pieces is ranked in so many parts.
BUCKETS = 1024
_RANKS = 1 << 40


class OpenWindows:
    """Runs of open windows by remaining capacity; a segment tree over capacities finds the tightest.

    Leaf ``c`` counts the windows with ``c`` places left, an inner node the sum
    of its two children.
    """

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _add(self, capacity: int, windows: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += windows
            node //= 2

    def push(self, capacity: int, first: int, windows: int) -> None:
        self.runs.setdefault(capacity, []).append((first, windows))
        self._add(capacity, windows)

    def pop(self, capacity: int) -> tuple[int, int]:
        first, windows = self.runs[capacity].pop()
        self._add(capacity, -windows)
        return first, windows

    def tightest(self, needed: int) -> int | None:
        """The least capacity of an open window with at least ``needed`` places left."""
        node = self.leaves + needed
        if self.count[node]:
            return needed
        while node > 1:  # up to the first right neighbour that holds a window, then down to its left
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pack ``lengths`` (pieces of each length) and return runs of places.

    A run ``(length, first, per_window, sequence, offset)`` says: the piece of
    this length with rank ``r``, from ``first`` on, goes to window ``sequence +
    (r - first) // per_window``, at ``offset + (r - first) % per_window *
    length``. The pieces of one length fill the tightest window until it is
    too small, so a run of equal windows is filled in one step. A run shrinks
    below half its capacity when it is filled, hence at most
    ``2 * window * log2(window)`` runs.
    """
    windows, runs, sequences = OpenWindows(window), [], 0
    for length in sorted(lengths, reverse=True):
        first, left = 0, lengths[length]
        while left:
            room = windows.tightest(length)
            if room is None:
                room, start, held = window, sequences, -(-left // (window // length))
                sequences += held
            else:
                start, held = windows.pop(room)
            per_window = room // length
            full = min(held, left // per_window)
            part = min(left - full * per_window, per_window - 1) if full < held else 0
            runs.append((length, first, per_window, start, window - room))
            if full and room > per_window * length:
                windows.push(room - per_window * length, start, full)
            if part:
                windows.push(room - part * length, start + full, 1)
            if rest := held - full - bool(part):
                windows.push(room, start + held - rest, rest)
            placed = full * per_window + part
            first, left = first + placed, left - placed
    return runs


def token_pieces(
    docs: DataFrame, vocabulary: Broadcast, window: int = 1024, closing_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of every document's ids and the closing id: ``doc_id, start, length, doc_tokens, ids``.

    ``ids`` holds little-endian unsigned 32-bit numbers; the added tokens of the
    vocabulary's file (``<|endoftext|>``) have their own ids, as the library gives them.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary.value
        encoder = piece_encoder(raw)
        for batch in batches:
            keys, held = batch.column(0), []
            parts = ((row, after, part) for row, text in enumerate(batch.column(1).to_pylist()) for part, after in segments(raw, text or ""))
            for key, texts, ends in chunks(parts):
                flat, counts = encoder.ids(texts)
                out, at = [], 0
                for (row, after), count, ended in zip(key, counts.tolist(), ends, strict=True):
                    held.append(flat[at : at + count])
                    at += count
                    if ended and after is not None:
                        held.append([after])
                    elif ended:
                        whole = np.concatenate([*held, [closing_id]]).astype("<u4")
                        out += [(row, k, len(whole), whole[k : k + window].tobytes()) for k in range(0, len(whole), window)]
                        held = []
                row, start, total, ids = zip(*out, strict=True) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, order: list[str | Column], window: int = 1024, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    ``order`` names the columns that rank pieces of one length.
    """
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    counts = spread.groupBy(length, "_bucket").agg(F.count("*").alias("_pieces"))
    counts = checkpointed(counts)  # at most window * BUCKETS rows
    told = {row[0]: row[1] for row in counts.groupBy(length).agg(F.sum("_pieces")).collect()}
    if told and not 0 < min(told) <= max(told) <= window:
        raise ValueError(f"pieces hold 1 to {window} tokens; found {min(told)} to {max(told)}")
    runs = np.array(sorted(best_fit(told, window)), np.int64).reshape(-1, 5)
    earlier = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(length, "_bucket", F.coalesce(F.sum("_pieces").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(length, "_bucket").orderBy(*order)
    ranked = spread.withColumn("_rank", F.row_number().over(within)).join(before, [length, "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1).drop("_bucket", "_before")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = runs[:, 0] * _RANKS + runs[:, 1]
        for batch in batches:
            size, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in (length, "_rank"))
            run = runs[np.searchsorted(firsts, size.astype(np.int64) * _RANKS + rank, "right") - 1]
            turn, slot = np.divmod(rank - run[:, 1], run[:, 2])
            out = {x: batch.column(x) for x in batch.schema.names if x != "_rank"}
            out |= {"sequence_id": pa.array(run[:, 3] + turn), "offset": pa.array(run[:, 4] + slot * size)}
            yield pa.RecordBatch.from_pydict(out)

    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)
