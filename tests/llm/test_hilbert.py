"""The curve visits neighbouring cells; runs are even; files prune."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from segmill.llm.hilbert import bands, hilbert_index, hilbert_shards, with_rank
from tests.llm.fixtures import documents, nothing


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3)])
def test_curve_steps_to_a_neighbour(spark, axes, bits):
    names = [f"a{k}" for k in range(axes)]
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=axes)), ", ".join(f"{x} int" for x in names))
    walk = [tuple(r[x] for x in names) for r in cells.withColumn("h", hilbert_index(names, bits)).orderBy("h").collect()]
    indices = [r[0] for r in cells.select(hilbert_index(names, bits).alias("h")).orderBy("h").collect()]
    assert indices == list(range((1 << bits) ** axes))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in itertools.pairwise(walk))


def _rows(docs):
    return with_rank(with_rank(docs, "source", "s"), "lang", "l").select(
        "doc_id",
        "shard",
        "s",
        "l",
        F.char_length("text").cast("double").alias("n"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"),
    )


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_runs_are_even_and_gapless(spark, law):
    docs = _rows(documents(spark, ["hot text"] * 200))
    got = hilbert_shards(docs, ["s", "l", "n"], 5, ["doc_id", "size"], "size", law).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    if law == "rows":
        assert set(by) == set(range(5)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert hilbert_shards(nothing(docs), ["s", "l", "n"], 5, ["doc_id", "size"], "size", law).count() == 0


def test_bytes_are_near_equal(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "double(id % 7) s", "double(id % 11) l", "double(id % 101) n", "id % 101 + 8 size")
    got = hilbert_shards(docs, ["s", "l", "n"], 6, ["doc_id"], "size", "bytes").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 6 and max(r.b for r in got) - min(r.b for r in got) <= 2 * 109


def test_ranks_of_texts_with_a_common_start(spark):
    names = [None, "", "https://common.example/a", "https://common.example/b", "https://common.example/b", "zé", "z"] * 3
    df = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "k int, source string").repartition(5).selectExpr("*", "7 AS rank")
    got = {r.k: r.rank for r in with_rank(df, "source", "rank").collect()}
    known = sorted(x for x in names if x is not None)
    assert got == {k: None if x is None else float(known.index(x)) for k, x in enumerate(names)}
    assert with_rank(df.where("false"), "source", "rank").count() == 0


def test_whole_operator_and_pruning(spark):
    """Rows in order of shard and slot follow the curve of their own bands; files of one source are few."""
    rows = [(k, f"https://site.example/{k % 7:02d}", "abc"[k % 3], float(k * k % 1009), k % 50 + 8) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n double, size long").repartition(3)
    df = with_rank(with_rank(df, "source", "s"), "lang", "l").cache()
    placed = hilbert_shards(df, ["s", "l", "n"], 24, ["doc_id", "size"], "size").collect()
    cuts = bands(df, ["s", "l", "n"])
    cells = {r.doc_id: r.h for r in df.withColumns(dict(zip("abc", cuts))).withColumn("h", hilbert_index(list("abc"))).collect()}
    walk = [cells[r.doc_id] for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    assert walk == sorted(walk) and len(walk) == 2000
    for k, name in enumerate("sln"):  # bands rise with the value, and a quantile's share of the rows is in each
        values = sorted((getattr(r, name), r.band) for r in df.withColumn("band", cuts[k]).collect())
        assert all(a[1] <= b[1] for a, b in itertools.pairwise(values))
    def read(wanted):  # files whose smallest and largest values let a filter skip them are not read
        spans = {}
        for r in placed:
            for name in ("s", "l", "n"):
                low, high = spans.get((r.shard, name), (1e18, -1e18))
                spans[r.shard, name] = min(low, getattr(r, name)), max(high, getattr(r, name))
        return [k for k in range(24) if all(spans[k, x][0] <= high and low <= spans[k, x][1] for x, (low, high) in wanted.items())]

    ranks = {x: sorted({getattr(r, x) for r in placed}) for x in ("s", "l", "n")}
    one = [len(read({x: (v, v)})) for x in ("s", "l") for v in ranks[x]]
    two = [len(read({"s": (a, a), "l": (b, b)})) for a in ranks["s"] for b in ranks["l"]]
    box = [len(read({"s": (a, a), "l": (b, b), "n": (0, 100)})) for a in ranks["s"] for b in ranks["l"]]
    shares = [sum(x) / len(x) for x in (one, two, box)]  # files read of 24
    assert shares[0] > shares[1] > shares[2] and shares[1] <= 16 and shares[2] <= 10, shares
