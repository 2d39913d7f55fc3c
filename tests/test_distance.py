"""Edit distances against the plain recurrence, in one tile, in many, and within narrow bands."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segmill.operators.distance import with_edits


def _plain(left, upper):
    row = list(range(len(upper) + 1))
    for i, a in enumerate(left, 1):
        before, row = row, [i]
        for j, b in enumerate(upper, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def _edited(rng, words, share):
    out = []
    for word in words:
        draw = rng.random()
        if draw < share:
            out += rng.choice([[], [word, "new"], ["other"]])
        else:
            out.append(word)
    return out


def _pairs():
    rng = random.Random(5)
    letters = "ab\U0001d4b3é"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 4)))
    rows = [("", ""), ("", "a b"), ("ab a", ""), ("a", "a"), (None, "a"), ("a", None), ("a b c", "a b c"), ("a b c", "a b c")]
    for size in (1, 5, 30, 70, 90):
        words = [word() for _ in range(size)]
        rows.append((" ".join(words), " ".join(_edited(rng, words, 0.15))))
        rows.append((" ".join(words), " ".join(word() for _ in range(size * 2))))
        rows.append((" ".join(words[size // 2 :] + words[: size // 2]), " ".join(words)))
    rows.append((" ".join(word() for _ in range(3)), " ".join(word() for _ in range(150))))
    rows.append(("", " ".join(word() for _ in range(100))))
    return rows


@pytest.mark.parametrize("tile", [64, 65_536])
def test_equal_to_the_plain_recurrence(spark, tile):
    rows = _pairs()
    df = spark.createDataFrame([(k, *row, "x") for k, row in enumerate(rows)], "id int, reference string, hypothesis string, pair string")
    got = with_edits(df, F.col("reference"), F.col("hypothesis"), tile)
    assert got.columns == ["id", "reference", "hypothesis", "pair", "word_edits", "char_edits"]
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(rows)
    for k, (left, upper) in enumerate(rows):
        if left is None or upper is None:
            want = (None, None)
        else:
            want = (_plain(left.split(), upper.split()), _plain(left.replace(" ", ""), upper.replace(" ", "")))
        assert (found[k].word_edits, found[k].char_edits) == want, (k, left, upper)


def test_empty_table(spark):
    df = spark.createDataFrame([], "reference string, hypothesis string")
    assert with_edits(df, F.col("reference"), F.col("hypothesis")).count() == 0


def test_long_pair_goes_by_tiles(spark):
    """50,000 words a side: inserted words that occur nowhere else cost one edit each."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(30_000)}" for _ in range(50_000)]
    changed = [w for k, word in enumerate(words) for w in ((word, "inserted") if k % 100 == 50 else (word,))]
    df = spark.createDataFrame([(" ".join(words), " ".join(changed))], "reference string, hypothesis string")
    row = with_edits(df, F.col("reference"), F.col("hypothesis")).first()
    assert (row.word_edits, row.char_edits) == (500, 4_000)
