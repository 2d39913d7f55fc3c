"""Byte-level BPE over a whole corpus, each distinct word encoded once.

``encode`` splits texts into words (the pieces of the vocabulary's pattern) by
blocks of documents. A block keeps the positions of its words as indices into
its own list of distinct words; only that list is shuffled, dealt to
``BUCKETS`` by a hash of the word, so all occurrences of a distinct word meet in
one bucket and are encoded there once. A block's words of one bucket travel as
one compressed row, and so do their ids, which the block puts back by position.
``decode`` looks ids up in the token-byte table.

Both halves of a block come from the same rows, read twice. A block's key is a
hash of its content, and a block that does not get all of its words raises, so
rows that changed between the two readings cannot give wrong ids.

Defined results: a null or empty text has no ids. One row comes out per row that
goes in, repeated rows included; an empty table gives an empty result. Columns
other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.pretokens import Lexicon, chunks, pieces, ragged
from segmill.llm.vocabularies import decode as decode_ids
from segmill.llm.vocabularies import encoding

#: A block of documents ends at so many characters or distinct words.
BLOCK_CHARS, BLOCK_WORDS = 5_000_000, 150_000
#: Buckets of words, and how many distinct words of its bucket a task remembers with their ids.
BUCKETS, REMEMBERED = 1024, 100_000
#: Rows of an Arrow batch that are Python objects at once.
SLICE = 256


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches, which may hold tens of megabytes, a few rows at a time."""
    for batch in batches:
        yield from (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: the upper planes are nearly constant."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(planes: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(planes), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _packed(items: list[bytes]) -> bytes:
    """Byte strings in one compressed row: their number, lengths and contents."""
    sizes = np.array([len(items), *map(len, items)], "<u4")
    return zstandard.compress(sizes.tobytes() + b"".join(items), 1)


def _unpacked(row: bytes) -> tuple[np.ndarray, bytes]:
    """The lengths of the byte strings and their contents, joined."""
    whole = zstandard.decompress(row)
    count = int(np.frombuffer(whole, "<u4", 1)[0])
    return np.frombuffer(whole, "<u4", count, 4).astype(np.int64), whole[4 * count + 4 :]


class _Block:
    def __init__(self) -> None:
        self.rows, self.counts, self.words, self.codes, self.chars = [], [], [], [], 0
        self.seen, self.dealt = Lexicon(), []

    def buckets(self) -> np.ndarray:
        """The bucket of each distinct word."""
        return np.array(self.dealt, np.int64)

    def add(self, keys: list[tuple], texts: list[str], ends: list[bool], open_row: int) -> int:
        """Take some texts; returns the words so far of a row that goes on in the next ones."""
        codes, counts, forms = pieces(texts)
        numbers, new = self.seen.number(forms)
        self.words += new
        self.dealt += [xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS for word in new]
        self.codes.append(numbers[codes].astype(np.uint32))
        for (key,), count, ended in zip(keys, counts.tolist(), ends, strict=True):
            open_row += count
            if ended:
                self.rows.append(key), self.counts.append(open_row)
                open_row = 0
        self.chars += sum(map(len, texts))
        return open_row

    def key(self) -> int:
        told = xxhash.xxh3_64(repr(self.rows).encode())
        for codes in self.codes:
            told.update(codes.tobytes())
        told.update("\0".join(self.words).encode("utf-8", "surrogatepass"))
        return told.intdigest() - (1 << 63)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    rows = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for b in _slices(batches))
    block, open_row = _Block(), 0
    for keys, texts, ends in chunks(rows):
        open_row = block.add(keys, texts, ends, open_row)
        if not open_row and (block.chars >= BLOCK_CHARS or len(block.words) >= BLOCK_WORDS):
            yield block
            block = _Block()
    if block.rows:
        yield block


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        key, buckets = block.key(), block.buckets()
        order = np.argsort(buckets, kind="stable")
        numbers, starts = np.unique(buckets[order], return_index=True)
        parts = np.split(order, starts[1:]) if len(numbers) else []
        rows = [_packed([block.words[k].encode("utf-8", "surrogatepass") for k in part]) for part in parts]
        columns = [pa.array(numbers, pa.int64()), pa.array([key] * len(rows), pa.int64()), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "words"])


def encode(docs: DataFrame, vocabulary: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit numbers) of every row's whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    arrow_kind = source.select("doc_id").limit(0).toArrow().schema.field(0).type

    def positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes = np.concatenate([np.zeros(0, np.uint32), *block.codes])
            columns = [
                pa.array([block.key()]),
                pa.array([block.rows], pa.list_(arrow_kind)),
                pa.array([block.counts], pa.list_(pa.int64())),
                pa.array([_planes(block.buckets())], pa.binary()),
                pa.array([_planes(codes)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "rows", "counts", "buckets", "codes"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, known = encoding(vocabulary.value), None, {}
        for batch in batches:  # in order of the buckets
            out = []
            for bucket, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                sizes, whole = _unpacked(row)
                ends = np.cumsum(sizes).tolist()
                words = [whole[end - size : end] for end, size in zip(ends, sizes.tolist(), strict=True)]
                if len(known) > REMEMBERED:
                    known = {}
                for word in words:
                    if word not in known:
                        known[word] = np.array(encoder.encode_ordinary(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                out.append(_packed([known[word] for word in words]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    def reassemble(blocks: pa.Table, words: pa.Table) -> pa.Table:
        parts = dict(zip(words["bucket"].to_pylist(), words["ids"].to_pylist(), strict=True))  # an equal block has the same words
        unpacked = [_unpacked(parts[k]) for k in sorted(parts)]
        sizes = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in unpacked]]) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"".join(x for _, x in unpacked), "<u4")
        rows, out = [], []
        for block in blocks.to_pylist():
            buckets = _numbers(block["buckets"])
            if len(buckets) != len(sizes):
                raise RuntimeError("a block's rows changed between two readings of the input")
            place = np.empty(len(buckets), np.int64)  # of each word in order of the buckets
            place[np.argsort(buckets, kind="stable")] = np.arange(len(buckets))
            codes, at = place[_numbers(block["codes"])], 0
            for row, count in zip(block["rows"], block["counts"], strict=True):
                ids = ragged(flat, starts, codes[at : at + count])[0]
                rows.append(row), out.append(ids.astype("<u4").tobytes())
                at += count
        return pa.table([pa.array(rows, arrow_kind), pa.array(out, pa.binary())], ["doc_id", "ids"])

    blocks = source.mapInArrow(
        positions, f"block long, rows array<{kind}>, counts array<long>, buckets binary, codes binary"
    )
    words = source.mapInArrow(_word_rows, "bucket long, block long, words binary").repartition("bucket")
    encoded = words.sortWithinPartitions("bucket").mapInArrow(merge, "block long, bucket long, ids binary")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(reassemble, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Add ``decoded``, the bytes that the ids stand for; the token-byte table has a row for each of the vocabulary's ids."""

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            every = batch.column("ids").to_pylist()
            out = [None if x is None else decode_ids(vocabulary.value, np.frombuffer(x, "<u4")) for x in every]
            held = {name: batch.column(name) for name in batch.schema.names if name != "decoded"}
            yield pa.RecordBatch.from_pydict(held | {"decoded": pa.array(out, pa.binary())})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded"]
    return encoded.mapInArrow(look_up, ", ".join([*kept, "decoded binary"]))
