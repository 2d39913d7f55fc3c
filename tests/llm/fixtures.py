"""Awkward documents: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

LONG = " ".join(f"word{k % 997} the cat's {k}" for k in range(30_000))
TEXTS = [
    None,
    "",
    " ",
    "\n\n\t",
    "one",
    "The cat's out; we'll see.  It's  1234 a b été \U0001d4b3\n\n x",
    "<|endoftext|> it'S 'tis ''s 're x're ٣٤ ",
    "same text here again and again",
    "same text here again and again",
    LONG,
]


def documents(spark, extra=()):
    rows = [(k, text, None if k % 4 == 0 else f"src{k % 3}", "en" if k % 3 else None, 0) for k, text in enumerate(TEXTS)]
    rows += [rows[4], rows[4]]  # repeated rows
    rows += [(100 + k, text, "hot", "en", 0) for k, text in enumerate(extra)]
    columns = "doc_id long, text string, source string, lang string, n_chars long"
    clash = ["shard", "slot", "length", "offset", "ids", "block", "kept", "word", "label", "fingerprint", "spans"]
    df = spark.createDataFrame(rows, columns)
    for name in clash:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def nothing(df):
    return df.where("false")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = "the an er on ti ou re ha ing ble st ed nd sh or".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words))
