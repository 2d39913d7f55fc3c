"""Packing and byte-level BPE against the tokenizer libraries themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from segmill.llm import bpe, packing, pretokens
from segmill.llm.tables import vocabulary
from segmill.llm.vocabularies import PieceEncoder, encoding, ranks, segments
from tests.llm.fixtures import TEXTS, documents, nothing, prose

RAW = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
JSON = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()


def _library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _twins(size):
    """Two words that polynomial hashes modulo powers of two cannot tell apart: Thue-Morse and its complement."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(size))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_weak_hashes_confuse(spark, size):
    pair = list(_twins(size))
    assert len(pretokens.pieces(pair)[2]) == 2
    known, encoder = encoding(RAW), PieceEncoder(RAW)
    assert encoder.ids(pair)[0].tolist() == [x for t in pair for x in known.encode_ordinary(t)]
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string").repartition(1)
    shared = vocabulary(spark, "byte_bpe_50k.tiktoken")
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs, shared), shared).collect()}
    assert got == dict(enumerate(pair))


def test_pieces_are_the_matches_of_the_pattern():
    rng = random.Random(3)
    letters = [*"abstmdrevl''  \n\t 12é½²中٣ _-", "\x1c", "\x85", "　", "\U0001d4b3", "'s", "'re", "'ll"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(5000)]
    codes, counts, forms = pretokens.pieces(texts)
    found = [forms[k] for k in codes]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text, end, count in zip(texts, np.cumsum(counts), counts, strict=True):
        assert found[end - count : end] == pattern.findall(text)


def test_long_texts_are_cut_where_a_piece_starts():
    text = TEXTS[-1]
    parts = [t for _, texts, _ in pretokens.chunks([(0, text)], 1000) for t in texts]
    assert "".join(parts) == text and len(parts) > 50
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert [x for part in parts for x in pattern.findall(part)] == pattern.findall(text)


def test_ids_equal_the_tokenizers_library(monkeypatch):
    assert ranks(JSON) == ranks(RAW)
    monkeypatch.setattr("segmill.llm.vocabularies.REMEMBERED", 5000)
    encoder, library = PieceEncoder(JSON), _library()
    added = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>", "<|endoftext|  ", "a  <|endoftext|>  b"]
    for texts in ([x or "" for x in TEXTS], added, [prose(k, 200) for k in range(20)]):
        for text in texts:
            got = []
            for part, after in segments(JSON, text):
                flat, counts = encoder.ids([part])
                assert counts.sum() == len(flat)
                got += [*flat.tolist(), *([] if after is None else [after])]
            assert got == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode(spark, monkeypatch):
    docs = documents(spark).repartition(3)
    known = encoding(RAW)
    shared = vocabulary(spark, "byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, shared), shared).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(got) == docs.count()
    for row in got:
        text = texts[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == known.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.encode(nothing(docs), shared).count() == 0


def test_equal_blocks_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    rows = [(1, "same words"), (1, "same words"), (2, "other words of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    union = df.unionByName(df)  # two partitions with equal blocks
    shared = vocabulary(spark, "byte_bpe_50k.tiktoken")
    got = sorted((r.doc_id, len(r.ids)) for r in bpe.encode(union, shared).collect())
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(RAW), special_tokens={})
    assert got == sorted((k, 4 * len(known.encode_ordinary(t))) for k, t in rows * 2)


def _naive(lengths, window):
    """Best-fit decreasing, one piece after the other."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fitting = [(room, k) for k, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting)[1]] -= size
        else:
            rooms.append(window - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_bulk_best_fit_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 50])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 300))]
    counts = {k: lengths.count(k) for k in set(lengths)}
    runs = sorted(packing.best_fit(counts, window))
    used, places = {}, {}
    for length, count in counts.items():
        mine = [r for r in runs if r[0] == length]
        for rank in range(count):
            _, first, per, sequence, offset = [r for r in mine if r[1] <= rank][-1]
            where = sequence + (rank - first) // per
            at = offset + (rank - first) % per * length
            used[where] = used.get(where, 0) + length
            places.setdefault(where, []).append((at, length))
    assert sorted(window - x for x in used.values()) == _naive(lengths, window)
    for spans in places.values():
        end = 0
        for at, length in sorted(spans):
            assert at == end
            end += length
        assert end <= window


def test_packed_documents(spark):
    docs = documents(spark, [prose(5, 300)] * 40 + ["a <|endoftext|> b", "x  <|endoftext|>"])
    pieces = packing.token_pieces(docs, vocabulary(spark, "byte_bpe_50k.json"), window=64)
    packed = packing.pack(pieces, ["doc_id", "start", "ids"], window=64).collect()
    library, texts = _library(), docs.select("doc_id", "text").collect()
    expected = sorted(
        (k, at, zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes()), len(ids))
        for k, text in texts
        for ids in [library.encode(text or "", add_special_tokens=False).ids + [0]]
        for at in range(0, len(ids), 64)
    )
    assert sorted((r.doc_id, r.start, zlib.crc32(r.ids), r.doc_tokens) for r in packed) == expected
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) == -(-sum(ends.values()) // 64)
    empty = packing.token_pieces(nothing(docs), vocabulary(spark, "byte_bpe_50k.json"))
    assert packing.pack(empty, ["doc_id", "start"]).count() == 0


def test_a_batch_is_not_taken_into_python_whole():
    import tracemalloc

    import pyarrow as pa

    from segmill.llm import bpe, pretokens

    pretokens._classes.cache_clear()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20_000)), "text": pa.array(["a" * 1000]).take(pa.array([0] * 20_000))})
    tracemalloc.start()
    rows = [row for block in bpe._blocks(iter([batch])) for row in block.rows]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == list(range(20_000))
    assert peak < 25_000_000
    assert [b.num_rows for b in bpe._slices([batch.slice(0, 600)])] == [256, 256, 88]
