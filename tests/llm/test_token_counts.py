"""The compiled transducer and the counts against the tokenizers library itself."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmill.llm import token_counts, transducer
from segmill.llm.tables import vocabulary
from segmill.llm.transducer import START, Transducer
from tests.llm.fixtures import TEXTS, documents, nothing, prose

RAW = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
LETTERS = [
    *"abstmdrevl''  \n\t 12é½²中٣ _-<|>", "\x1c", "\x85", "　", "\U0001d4b3", "'s", "'re", "'ll", "<|endoftext|>", "<|endof", "aaaa", "    ",
    "the", " and", "----", "ation", "ing", " re", "requ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _random(seed, count, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, most))) for _ in range(count)]


def test_counts_equal_the_library(library):
    machine = Transducer(RAW)
    texts = _random(5, 4000, 30) + TEXTS + [prose(k, 300) for k in range(10)] + ["a" * 5000, " " * 3000 + "x", "-" * 777, "ab" * 2000, "中" * 500]
    assert [machine.count(t or "") for t in texts] == _expected(library, texts)


def test_forgotten_states_change_nothing(library, monkeypatch):
    monkeypatch.setattr(transducer, "KEPT", 40)
    monkeypatch.setattr(transducer, "TOKENS", 30)
    machine, texts = Transducer(RAW), _random(6, 300, 30)
    assert [machine.count(t) for t in texts] == _expected(library, texts)
    assert len(machine.states) <= 40


def test_maps_compose_at_every_cut():
    """Running a text in two parts from the state between them is running it at once."""
    machine = Transducer(RAW)
    for text in _random(7, 60, 12) + ["it's  <|endoftext|> 're\n\n x"]:
        whole = machine.count(text)
        for cut in range(len(text) + 1):
            state, n = machine.run(START, text[:cut])
            after, m = machine.run(eval(repr(state)), text[cut:])
            assert n + m + machine.finish(after) == whole


@pytest.mark.parametrize("back", [256, 0])
def test_documents(spark, library, monkeypatch, back):
    """Cut into short chunks; with nothing read before a chunk, the first guesses are mostly wrong."""
    monkeypatch.setattr(token_counts, "BACK", back)
    extra = [*_random(8, 30, 60), "<|endoftext|>" * 20, "it's " * 40, prose(9, 400)]
    docs = documents(spark, extra).where("doc_id <> 9").unionByName(documents(spark).where("doc_id = 5").selectExpr("* except (doc_id)", "CAST(null AS LONG) AS doc_id"))
    got = token_counts.token_counts(docs, vocabulary(spark, "byte_bpe_50k.json"), chunk=40).collect()
    texts = docs.select("doc_id", "text").collect()
    expected = zip(texts, _expected(library, [r.text for r in texts]), strict=True)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got)) == sorted(
        (-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n) for r, n in expected
    )
    assert token_counts.token_counts(nothing(docs), vocabulary(spark, "byte_bpe_50k.json")).count() == 0


def test_endless_words_and_rounds(spark, library, monkeypatch):
    """Words without an end hand on new states from chunk to chunk; with no rounds left they are read in order."""
    texts = ["a" * 1500, "ab" * 800, "-" * 2000, "中" * 300, " " * 999, "x y " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (6, 0):
        monkeypatch.setattr(token_counts, "ROUNDS", rounds)
        monkeypatch.setattr(token_counts, "BACK", 3)
        got = token_counts.token_counts(docs, vocabulary(spark, "byte_bpe_50k.json"), chunk=100).collect()
        assert [r.n_tokens for r in sorted(got)] == _expected(library, texts)


def test_prefix_scan_gives_the_count_up_to_each_chunk(spark):
    text, size = "the cat's  out; we'll see " * 12, 17
    machine, broadcast = Transducer(RAW), vocabulary(spark, "byte_bpe_50k.json")
    starts = range(0, len(text), size)
    rows = [("t", k, at + size >= len(text), text[max(0, at - 5) : at], text[at : at + size]) for k, at in enumerate(starts)]
    maps, endless = token_counts.chunk_maps(spark.createDataFrame(rows, "key string, chunk long, last boolean, back string, text string"), broadcast)
    assert endless.count() == 0
    got = {r.chunk: r.n for r in token_counts.scanned(maps).collect()}
    expected = {k: machine.run(START, text[: at + size])[1] for k, at in enumerate(starts)}
    expected[len(starts) - 1] = machine.count(text)
    assert got == expected
