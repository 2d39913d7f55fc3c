"""Spans against Python's matches; disclosure against counted documents."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from segmill.llm import pii
from tests.llm.fixtures import TEXTS, documents, nothing

EXTRA = [
    "mail a.b+c@ex-ample.co.uk, x@y and _z@q.r.",
    "a@b.c_d@e.f %@a..b x@y.z@w.v a@b.c",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111111111 4111  1111",
    "+49 (0)30 1234-5678 and +1 2 +4912345678901234567 ++1 234 567 89 01 x",
    "é\U0001d4b3 contact\U0001d4b3 é.x@y.zz +44 20 7946 0958\n4242424242424242",
    "7" * 50_000 + " a@" + "b." * 20_000 + "c",
    "x" * 30_000 + "@ y",
]


def _luhn(digits):
    total = 0
    for k, x in enumerate(reversed(digits)):
        x = int(x) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _plain(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x[-9:]) <= 255 and int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = []
    for order, (kind, (pattern, good)) in enumerate(tests.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if good(m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans(spark):
    extra = EXTRA[:-2]
    docs = documents(spark, extra)
    got = pii.find(docs).select("doc_id", pii.span_list("base").alias("spans")).collect()
    texts = dict(enumerate(TEXTS)) | {100 + k: t for k, t in enumerate(extra)}
    assert len(got) == docs.count()
    for row in got:
        assert row.spans == _plain(texts[row.doc_id]), row.doc_id
    assert pii.find(nothing(docs)).count() == 0


def test_very_long_runs(spark):
    df = spark.createDataFrame(list(enumerate(EXTRA[-2:])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).select("doc_id", pii.span_list("base").alias("spans")).collect()}
    assert got == {0: f"email:50001:{50_001 + 2 + 40_001}", 1: ""}


def _corpus(spark):
    """Two documents share an entity and the word beside it; a common word stands beside it too."""
    rows = [(k, f"ordinary common filler words number{k} here\nand common others") for k in range(60)]
    rows += [(100, "common zanzibarian boss@corp.example common"), (101, "The Zanzibarian: boss@corp.example wrote common")]
    rows += [(102, "only once@corp.example singular"), (102, "only once@corp.example singular"), (103, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "base": F.lit(2)})


def test_terms_that_disclose(spark):
    docs = _corpus(spark)
    told = pii.disclosing_terms(pii._scanned(docs, "doc_id", "text"), docs).collect()
    assert [(r.entity, r.term) for r in told] == [("email:boss@corp.example", "zanzibarian")]
    n, ne, nt, both = 65, 2, 2, 2
    assert told[0].disclosure == pytest.approx(math.log(n * both / (nt * ne)) / math.log(n / ne))
    got = {r.doc_id: r.spans for r in pii.find(docs).select("doc_id", pii.span_list("spans").alias("spans")).collect()}
    assert got[100] == "term:7:18,email:19:36"
    assert got[101] == "term:4:15,email:17:34"
    assert got[102] == "email:5:22" and got[0] == "" and got[103] == ""


def test_sanitised_texts(spark):
    docs = _corpus(spark)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[100] == "common  [EMAIL] common"
    assert texts[101] == "The : [EMAIL] wrote common"
    assert texts[102] == "only [EMAIL] singular" and texts[103] is None
    assert texts[0] == docs.where("doc_id = 0").first().text
    assert pii.sanitise(nothing(docs)).count() == 0


def test_every_occurrence_of_a_telling_term(spark):
    far = "filler " * 40
    rows = [(k, f"ordinary common filler words number{k} here\nand common others") for k in range(60)]
    rows += [(100, f"Kowalczyk: a@b.example\n{far}\n\U0001d4b3 kowalczyk, KOWALCZYK kowalczyks"), (101, f"Kowalczyk {far}\n{far} a@b.example")]
    rows += [(102, "filler without")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted((r.doc_id, r.text) for r in pii.sanitise(docs).where("doc_id >= 100").collect())
    assert texts == [
        (100, f": [EMAIL]\n{far}\n\U0001d4b3 ,  kowalczyks"),
        (101, f" {far}\n{far} [EMAIL]"),
        (102, "filler without"),
    ]


def test_two_hundred_thousand_matches(spark):
    text = "".join(f"w a{k}@b.example " for k in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    row = pii.find(docs).where("doc_id = 1").select(F.size("base").alias("n"), F.col("base")[199_999]["end"].alias("end")).first()
    assert (row.n, row.end) == (200_000, len(text) - 1)
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert texts == {1: "w [EMAIL] " * 200_000, 2: "x"}


def test_many_terms_and_entities_of_one_text(spark):
    """10,000 rare terms and 1,000 entities of the same two texts are one pair of classes; each term is still found."""
    letters = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    body = " ".join(f"zz{letters(k)}" for k in range(10_000)) + " " + " ".join(f"e{k}@b.example" for k in range(1_000))
    rows = [(k, f"filler words number{k}") for k in range(60)] + [(100, body), (101, body + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = pii._scanned(docs, "doc_id", "text")
    assert pii._weighed(scanned, docs, "text")["told"].count() == 1
    kinds = F.expr("size(filter(spans, s -> s.kind = 'term'))")
    # The domain's words are inside the entities, so only the texts' own words are terms.
    assert {r.doc_id: r.n for r in pii.find(docs).where("doc_id >= 100").select("doc_id", kinds.alias("n")).collect()} == {100: 10_000, 101: 10_000}


def test_overlapping_spans_across_chunks(spark):
    """An address as long as several chunks, a phone number inside a card's digits, marks at chunk edges."""
    long = "a" * (2 * pii.CHUNK + 5) + "@b.example"
    edge = "\u2603" * (pii.CHUNK - 3) + " x@y.zz"
    both = "+4111 1111 1111 1111 end"
    docs = spark.createDataFrame([(1, f"{edge} {long} tail"), (2, both), (3, f"{edge}")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    head = "\u2603" * (pii.CHUNK - 3)
    assert texts == {1: f"{head} [EMAIL] [EMAIL] tail", 2: "+[CARD] end", 3: f"{head} [EMAIL]"}


def test_names_that_the_operator_uses_itself(spark):
    names = ["row", "row1", "row2", "t", "c", "chunk", "marks", "made", "base", "spans", "at", "entities", "_row1", "_spans", "_key1"]
    docs = spark.createDataFrame([(1, "a@b.example x")], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert out.first().asDict() == {"doc_id": 1, "text": "[EMAIL] x", **{n: n for n in names}}
