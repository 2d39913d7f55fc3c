"""Scores against a model counted in plain Python."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segmill.llm import lm_scoring as lm
from tests.llm.fixtures import documents, nothing, prose


def _grams(text):
    padded = lm.START * 3 + (text or "").lower() + lm.STOP
    return [padded[k - 3 : k + 1] for k in range(3, len(padded))]


def _model(texts, letters):
    counts = Counter(g for t in texts for g in _grams(t))
    sums = [Counter() for _ in range(5)]
    contexts = [Counter() for _ in range(5)]
    for gram, n in counts.items():
        for order in range(1, 5):
            sums[order][gram[4 - order :]] += n
            contexts[order][gram[4 - order : 3]] += n
    cache = {}

    def loss(gram):
        if gram not in cache:
            p = (1 - sum(lm.WEIGHTS)) / letters
            for order, weight in enumerate(lm.WEIGHTS, 1):
                whole = contexts[order][gram[4 - order : 3]]
                p += weight * (sums[order][gram[4 - order :]] / whole if whole else 1 / letters)
            cache[gram] = -math.log(p)
        return cache[gram]

    return loss


@pytest.mark.parametrize("block", [lm.BLOCK_CHARS, 200])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_CHARS", block)
    monkeypatch.setattr(lm, "CHUNK", 500)
    docs = documents(spark, [prose(k, 40) for k in range(5)] + ["Zzz qqq"]).where("n_chars = 0 AND coalesce(length(text), 0) < 5000").repartition(2)
    target = spark.createDataFrame([(prose(1, 60),), ("an other",), (None,)], "text string")
    rows, wanted = docs.select("doc_id", "text").collect(), [r.text for r in target.collect()]
    letters = len({g[3] for t in [r.text for r in rows] + wanted for g in _grams(t)})
    near, far = _model(wanted, letters), _model([r.text for r in rows], letters)
    got = lm.cross_entropy_difference(docs, target).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        grams = _grams(texts[r.doc_id])
        assert r.n_tokens == len(grams)
        t, b = (sum(map(loss, grams)) / len(grams) for loss in (near, far))
        assert (r.target_entropy, r.background_entropy, r.score) == pytest.approx((t, b, t - b), rel=1e-9, abs=1e-12)


def test_probabilities_sum_to_one(spark):
    letters = "abc" + lm.STOP
    rows = spark.createDataFrame([("abca" + "b" * k,) for k in range(6)] + [("c",)], "text string")
    grams = lm.gram_rows(rows, F.lit(0), F.col("text"))
    every = spark.createDataFrame([(x + y, 0) for x in ("abc", "zab", "zzz", "bbb") for y in letters], "gram string, n long")
    losses = lm.model_losses(every, grams.select("gram", "n").unionByName(every.select("gram", "n"))).collect()
    by = {}
    for r in losses:
        by.setdefault(r.gram[:3], []).append(math.exp(-r.background_loss))
    for context in ("abc", "zab", "zzz", "bbb"):
        assert sum(by[context]) == pytest.approx(1.0)


def test_empty_tables(spark):
    docs = documents(spark)
    target = spark.createDataFrame([], "text string")
    got = lm.cross_entropy_difference(docs.where("doc_id < 5"), target).collect()
    assert len(got) == 7 and len({round(r.target_entropy, 9) for r in got}) == 1
    assert lm.cross_entropy_difference(nothing(docs), target).count() == 0
