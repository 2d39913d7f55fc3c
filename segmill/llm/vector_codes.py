"""Vector code compression (product quantisation) of integer vectors, trained with Drake and Hamerly's adaptive bounds.

Vectors are cut into equal consecutive parts, each with a codebook of its own,
trained by rounds of assignment and means. Beside each part the state table
keeps its entry, the ``b`` next closest entries in order, a lower bound for each
of these that also holds for all entries after it, and one outer bound for all
others. When the codebooks have moved, bounds sink by how far their entries
moved, the outer one by the farthest move. The exact distance to the own entry
then tells how many of the listed entries can still be closer: none, and the
part keeps its entry; the first few, and their exact integer distances decide;
or even an unlisted one, and all entries are compared. Bounds are rounded down
and a tie is never excluded, so results equal those of comparing everything.

``b`` adapts: a round's counts of entries in doubt, a histogram of at most
``b + 2`` rows, set the number kept in the next round to what ``SHARE`` of the
parts needed, never more than before and at least ``LEAST``.

Every round reads the state of the round before and writes its own. Tasks add
up their parts by entry, so what is shuffled and comes to the driver has a row
for each component of the codebooks.

Defined results: vectors that are null or hold null or non-finite components are
left out, and so are vectors of another length than ``width`` (None: the most
frequent length, of equally frequent ones the larger). Equal ids are vectors of
their own; null ids come last in the first codebooks. With fewer than
``entries`` vectors the codebooks are as small; an empty table gives an empty
result. Components so large that squared distances leave 64 bits raise an error.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.integers import SLACK, floors, matrix, means, packed, squared, squared_to_all, unpacked, usable
from segmill.session import checkpointed

#: Listed entries at first and at least, and the share of parts that the next round's list shall serve.
KEPT, LEAST, SHARE = 32, 4, 0.95
#: Vectors handled at once.
ROWS = 2048
_FAR = np.iinfo(np.int64).max


def _down(values: np.ndarray) -> np.ndarray:
    """In single precision, never more than before."""
    out = values.astype(np.float32)
    return np.where(out > values, np.nextafter(out, np.float32(-np.inf)), out)


def _ordered(bounds: np.ndarray) -> np.ndarray:
    """Each bound lowered to the least of those after it, so that it holds for these entries too."""
    return np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]


def _roots(distances: np.ndarray) -> np.ndarray:
    return np.sqrt(distances.astype(float)) * (1 - SLACK)


def search_all(part: np.ndarray, book: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, next closest entries and bounds of every row, by all distances."""
    every, rows = squared_to_all(part, book), np.arange(len(part))
    code = every.argmin(1)
    every[rows, code] = _FAR
    bounds = np.full((len(part), kept + 1), np.inf)
    listed = min(kept + 1, len(book) - 1)
    near = np.argpartition(every, max(0, listed - 1), axis=1)[:, :listed] if listed else np.zeros((len(part), 0), np.int64)
    near = np.take_along_axis(near, np.take_along_axis(every, near, 1).argsort(1, kind="stable"), 1)
    bounds[:, :listed] = _roots(np.take_along_axis(every, near, 1))
    full = np.zeros((len(part), kept), np.int64)
    full[:, : min(kept, listed)] = near[:, :kept]
    return code, full, bounds


def search_near(
    part: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, near: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, next closest entries and bounds after the codebook moved, and how many bounds were in doubt."""
    kept = near.shape[1]
    bounds = bounds.astype(float)
    bounds[:, :kept] -= moved[near]
    bounds[:, kept] -= moved.max(initial=0)
    bounds = _ordered(bounds)
    own = squared(part, book[code])
    doubts = (bounds <= (np.sqrt(own.astype(float)) * (1 + SLACK))[:, None]).sum(1)
    code, near = code.astype(np.int64), near.astype(np.int64)

    some = np.flatnonzero((doubts > 0) & (doubts <= kept))
    if len(some):
        listed = np.column_stack([code[some], near[some]])
        asked = np.arange(kept + 1) <= doubts[some][:, None]
        exact = np.full(listed.shape, _FAR)
        row, place = np.nonzero(asked)
        exact[row, place] = squared(part[some][row], book[listed[row, place]])
        tie = np.where(asked, listed, len(book) + np.arange(kept + 1))  # what was not asked keeps its order
        order = np.lexsort((tie, exact), axis=-1)
        listed, exact = np.take_along_axis(listed, order, 1), np.take_along_axis(exact, order, 1)
        code[some], near[some] = listed[:, 0], listed[:, 1:]
        bounds[some, :kept] = np.where(asked[:, 1:], _roots(exact[:, 1:]), bounds[some, :kept])

    lost = np.flatnonzero(doubts > kept)
    if len(lost):
        code[lost], near[lost], bounds[lost] = search_all(part[lost], book, kept)
    return code, near, bounds, doubts


def _cut(near: np.ndarray, bounds: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """A shorter list; its outer bound also holds for the entries that left it."""
    bounds = _ordered(bounds)
    return near[:, :kept].astype(np.uint8), _down(bounds[:, : kept + 1])


class _Layout:
    """Where the columns of the state table come from and go to."""

    def __init__(self, parts: int, width: int) -> None:
        self.parts, self.width = parts, width

    def split(self, batch: pa.RecordBatch) -> np.ndarray:
        return unpacked(batch.column("vector"), "<i4", self.parts, self.width)

    def batch(self, rows: pa.RecordBatch, vectors: np.ndarray, states: list[tuple]) -> pa.RecordBatch:
        code, near, bounds, doubts = (np.stack(x, axis=1) for x in zip(*states, strict=True))
        columns = [rows.column("vec_id"), rows.column("label"), packed(vectors), packed(code.astype(np.uint8))]
        columns += [packed(near), packed(bounds), packed(doubts.astype("<u2"))]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "code", "near", "bounds", "doubts"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _first(layout: _Layout, books: np.ndarray, kept: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            vectors = matrix(batch.column("parts"), layout.parts * layout.width)
            split, states = vectors.reshape(-1, layout.parts, layout.width), []
            for k, book in enumerate(books):
                code, near, bounds = search_all(split[:, k], book, kept)
                states.append((code, *_cut(near, bounds, kept), np.zeros(len(code), np.int64)))
            yield layout.batch(batch, vectors, states)

    return each


def _next(layout: _Layout, books: np.ndarray, moved: np.ndarray, held: int, kept: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            split, states = layout.split(batch), []
            code = unpacked(batch.column("code"), "u1", layout.parts)
            near = unpacked(batch.column("near"), "u1", layout.parts, held)
            bounds = unpacked(batch.column("bounds"), "<f4", layout.parts, held + 1)
            for k, book in enumerate(books):
                found, listed, lower, doubts = search_near(split[:, k], book, moved[k], code[:, k], near[:, k], bounds[:, k])
                states.append((found, *_cut(listed, lower, kept), doubts))
            yield layout.batch(batch, split.reshape(len(split), -1), states)

    return each


def _sums(layout: _Layout, entries: int):
    """A task's sums and counts by part and entry, and its counts of doubts as rows of part -1."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((layout.parts, entries, layout.width), np.int64), np.zeros((layout.parts, entries), np.int64)
        doubts = np.zeros(entries + 2, np.int64)
        for batch in _pieces(batches):
            split, code = layout.split(batch), unpacked(batch.column("code"), "u1", layout.parts)
            for k in range(layout.parts):
                np.add.at(totals[k], code[:, k], split[:, k])
                counts[k] += np.bincount(code[:, k], minlength=entries)
            doubts += np.bincount(unpacked(batch.column("doubts"), "<u2", layout.parts).ravel(), minlength=len(doubts))
        part, entry = np.nonzero(counts)
        columns = [np.repeat(part, layout.width), np.repeat(entry, layout.width), np.tile(np.arange(layout.width), len(part))]
        columns += [totals[part, entry].ravel(), np.repeat(counts[part, entry], layout.width)]
        seen = np.flatnonzero(doubts)
        extra = [np.full(len(seen), -1), seen, np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64), doubts[seen]]
        columns = [np.concatenate(x).astype(np.int64) for x in zip(columns, extra, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["part", "entry", "place", "total", "count"])

    return each


def _adapted(doubts: dict[int, int], kept: int) -> int:
    """How many listed entries ``SHARE`` of the parts needed."""
    wanted, seen = SHARE * sum(doubts.values()), 0
    for number in sorted(doubts):
        seen += doubts[number]
        if seen >= wanted:
            return max(min(LEAST, kept), min(kept, number))
    return kept


def compress(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, width: int | None = None,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code`` (a byte for each part), ``error`` of every vector that takes part, and the codebooks (part, entry, component).

    Components are ``floor(scale * x)``. The first codebooks are the parts of
    the vectors with the least ids.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code's byte tells 1 to 256 entries apart")
    good = df.where(usable(embedding) & (F.size(embedding) > 0))
    if width is None:
        common = good.groupBy(F.size(embedding).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = common["width"] if common else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    layout = _Layout(parts, width // parts)
    kept_rows = good.where(F.size(embedding) == width).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), floors(embedding, scale).alias("parts"))
    least = kept_rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").toArrow()
    first = matrix(least.column(0).combine_chunks(), width).astype(np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, layout.width).transpose(1, 0, 2))
    kinds = [df.schema[x].dataType.simpleString() for x in (vec_id, label)]
    if not len(first):
        return kept_rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, vector binary, code binary, near binary, bounds binary, doubts binary"
    kept = min(KEPT, len(first) - 1)
    state = checkpointed(kept_rows.mapInArrow(_first(layout, books, kept), schema))
    for turn in range(rounds):
        sums = checkpointed(state.select("vector", "code", "doubts").mapInArrow(_sums(layout, len(first)), "part long, entry long, place long, total long, count long"))
        new = means(sums.where("part >= 0"), ["part", "entry"], books)
        doubts = {row[0]: row[1] for row in sums.where("part < 0").groupBy("entry").agg(F.sum("count")).collect()}
        moved = np.stack([np.sqrt(squared(a, b).astype(float)) * (1 + SLACK) for a, b in zip(new, books, strict=True)])
        held, kept = kept, _adapted(doubts, kept) if turn else kept
        state, books = checkpointed(state.mapInArrow(_next(layout, new, moved, held, kept), schema)), new
    last = books

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            split, code = layout.split(batch), unpacked(batch.column("code"), "u1", parts)
            error = sum(squared(split[:, k], last[k][code[:, k]]) for k in range(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("vec_id", "label", "code")), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "vector", "code").mapInArrow(finished, f"vec_id {kinds[0]}, label {kinds[1]}, code binary, error long"), last


def with_label_error(found: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over equal labels, nulls together."""
    found = checkpointed(found)
    sums = checkpointed(found.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error")))
    return found.join(sums, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
