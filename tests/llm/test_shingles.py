"""Near-copies against all pairs' true shingle similarity."""

from __future__ import annotations

import random

from segmill.llm import shingles
from tests.llm.fixtures import nothing, prose


def _set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def _edited(text, rng, edits):
    words = text.split()
    for place in rng.sample(range(len(words)), edits):
        words[place] = f"edit{rng.random()}"
    return " ".join(words)


def test_edited_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BUCKET_ROWS", 20)
    rng, texts = random.Random(3), []
    for k in range(60):
        base = prose(k, rng.randint(60, 300))
        texts += [base, _edited(base, rng, 1), _edited(base, rng, 2), _edited(base, rng, 9)]
    hub = prose(999, 100)
    texts += [_edited(hub, rng, 1 + k % 3) for k in range(60)]
    sets = [_set(x) for x in texts]
    least = list(range(len(texts)))
    linked = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in shingles.keep_one(docs).collect())
    assert kept == sorted(set(least))
    assert len(linked) > 100 and len(kept) > 80
    assert shingles.keep_one(nothing(docs)).count() == 0


def test_keys_reach_the_threshold():
    rng, met, pairs = random.Random(5), 0, 0
    while pairs < 300:
        base = prose(rng.getrandbits(30), rng.randint(60, 300))
        a, b = shingles.shingles(base), shingles.shingles(_edited(base, rng, max(1, len(base.split()) // 48)))
        if shingles.near(a, b):
            pairs += 1
            met += any(x == y for x, y in zip(shingles.band_keys(a), shingles.band_keys(b), strict=True))
    assert met == pairs
