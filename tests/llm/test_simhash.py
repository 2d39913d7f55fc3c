"""Fingerprints, pairs and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segmill.llm import groups, simhash
from tests.llm.fixtures import documents, nothing, prose


def _plain(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _components(ids, linked):
    least = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def test_documents_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 3)
    monkeypatch.setattr(simhash, "SAMPLE", 20)
    base = prose(1, 400)
    near = [base + f" tail{k}" for k in range(8)] + [base.replace("ing", "ING")] + [prose(k, 80) for k in range(2, 12)]
    docs = documents(spark, near)
    got = simhash.near_duplicates(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    prints = {k: _plain(t) for k, t in texts}
    assert all(r.fp % (1 << 64) == prints[r.doc_id] for r in got)
    ids = list(prints)
    links = [(a, b) for a in ids for b in ids if (prints[a] ^ prints[b]).bit_count() <= 4]
    least = _components(ids, links)
    assert {r.doc_id: r.component_id for r in got} == least
    assert len(set(least.values())) < len(least) - 8
    assert simhash.near_duplicates(nothing(docs)).count() == 0


@pytest.mark.parametrize(("radius", "rows"), [(4, 20_000), (4, 40), (7, 40)])
def test_chains_and_dense_balls(spark, monkeypatch, radius, rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 20)):
            for bit in rng.sample(range(64), rng.randint(1, radius + 1)):
                value ^= 1 << bit
            values.add(value)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame(list(enumerate(signed)), "point long, fp long")
    found = {r.node: r.component for r in groups.connected(simhash.near_links(points, radius), "a", "b").collect()}
    array = np.array(values, np.uint64)
    linked = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(array[:, None] ^ array[None, :]) <= radius), strict=True)]
    expected = _components(range(len(values)), linked)
    assert {k: found.get(k, k) for k in expected} == expected


def test_trees_lose_no_neighbour():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 16, 3000).astype(np.uint64)
    tree = simhash.fit_tree(values[:500])
    _, home = tree.visits(values, 0)
    own = dict(zip(*tree.visits(values, 0), strict=True))
    rows, shards = tree.visits(values, 1)
    visited = set(zip(rows.tolist(), shards.tolist(), strict=True))
    near = np.bitwise_count(values[:300, None] ^ values[None, :]) <= 1
    assert all((int(a), int(own[b])) in visited for a, b in zip(*np.nonzero(near), strict=True))
    assert len(set(home.tolist())) > 20 and len(rows) < 40 * len(values)


def test_long_paths_and_hubs(spark):
    path = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5)]
    got = groups.connected(spark.createDataFrame(path, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}
    assert got.groupBy("node").count().where(F.col("count") > 1).count() == 0
    assert groups.connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
