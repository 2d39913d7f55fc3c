"""Statistics against plain Python; the learned list on held-out rows."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segmill.llm.quality import STATISTICS, Rule, base_failed, judge, learn_rules, text_statistics, verdict
from tests.llm.fixtures import TEXTS, documents, nothing, prose

EXTRA = [
    "a b c d e a b c d e",
    "a b c d e f a b c d e x\nx\n \nx\nx y\n",
    "one two three four five six\n" * 50,
    "# * $ | < > & % \x0b\x0cword\x1cword ü\n\n",
    "a a a a a a a",
    prose(1, 500) + "\n" + prose(1, 20),
]


def _plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    symbols = sum(x in "#*$%&|<>" for x in text)
    upper = sum("A" <= x <= "Z" for x in text)
    return (
        len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered),
        len(lines), len(set(words)), upper, len(text),
    )


def test_statistics(spark):
    docs = documents(spark, EXTRA)
    got = text_statistics(docs).collect()
    assert len(got) == docs.count()
    texts = dict(enumerate(TEXTS)) | {100 + k: t for k, t in enumerate(EXTRA)}
    for row in got:
        assert tuple(row[x] for x in STATISTICS) == _plain(texts[row.doc_id]), row.doc_id
    assert text_statistics(nothing(docs)).count() == 0


def _corpus(spark, start, n):
    rows = []
    for k in range(start, start + n):
        text = prose(k, 60)
        if k % 4 == 1:
            text = " ".join(x + "###" for x in text.split())
        if k % 8 == 2:
            text = text.upper()
        rows.append((k, text, 0 if k % 4 == 1 or k % 8 == 2 else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_learned_list_on_held_out_rows(spark):
    docs, labels = _corpus(spark, 0, 240)
    _, rules = judge(docs, labels)
    assert 1 <= len(rules) <= 8 and all(r.conditions for r in rules)
    unseen, truth = _corpus(spark, 1000, 160)
    judged = text_statistics(unseen).withColumn("kept", ~base_failed() & verdict(rules)).join(truth, "doc_id")
    wrong = judged.where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 3


def test_no_labels_one_class_and_no_rows(spark):
    docs, labels = _corpus(spark, 0, 20)
    for few in (nothing(labels), labels.where("quality = 1"), labels.selectExpr("doc_id", "int(null) quality")):
        judged, rules = judge(docs, few)
        assert rules == [] and judged.where("kept").count() == 20
    assert judge(nothing(docs), labels)[0].count() == 0


def test_rules_apply_in_order(spark):
    assert str(Rule()) == " -> reject (0 bad, 0 good)"
    df = text_statistics(spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string"))
    assert df.select(verdict([]).alias("k")).first().k is True
    assert df.select(base_failed().alias("k")).first().k is True


@pytest.mark.parametrize("noise", [0, 1])
def test_noise_is_not_learned(spark, noise):
    rows = [(k, prose(k, 50)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(noise)), F.lit(2)) == 0).alias("_bad"))
    assert learn_rules(text_statistics(docs).join(bad, "doc_id"), "_bad") == []
