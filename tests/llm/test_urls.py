"""Rules against plain string work; the trees on held-out URLs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from segmill.llm.queries import URL_RULES
from segmill.llm.urls import host_and_path, judge_urls, lexical_features, listed, split_rule

URLS = [
    None, "", "no scheme", "http://", "http://A.NET", "http://a.net/x", "http://net/", "https://Example.NET/en/1?x=1", "http://xexample.net/en/2",
    "http://m.example.com/de/", "http://example.com/deutsch", "http://example.com?x=/de/", "ftp://w.org/fr/#a", "http://ÄB.org/fr/", "x://y://z.net/a",
    "http://a.b.net#/x", "//q.net/", "http://user@h.net:80/p//q", "http://a.net/x", "http://h/" + "x/" * 5000 + "\n?q",
]


def _plain(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def _pages(spark):
    return spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"host": F.lit("clash"), "score": F.lit(1)})


def test_hosts_paths_and_rules(spark):
    pages = _pages(spark)
    labelled = pages.select("url", listed(*host_and_path(F.col("url")), URL_RULES).alias("l")).where("l IS NOT NULL").select("url", "l.verdict")
    got = judge_urls(pages, labelled, URL_RULES).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path, rule, verdict = _plain(URLS[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in ("block", "allow") and verdict in (None, row.verdict)
    assert judge_urls(pages.where("false"), labelled, URL_RULES).count() == 0


@pytest.mark.parametrize(("labels", "expected"), [([], "allow"), (["block"], "block"), (["allow"], "allow")])
def test_one_class(spark, labels, expected):
    labelled = spark.createDataFrame([("http://a.b/c", x) for x in labels], "url string, verdict string")
    assert {r.verdict for r in judge_urls(_pages(spark), labelled, []).collect()} == {expected}


def test_features(spark):
    row = spark.createDataFrame([("http://a-b.c.net/p/qq.html?x=1&y=2",)], "url string")
    row = row.withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")), strict=True)))
    got = lexical_features(row).first()
    url = got.url
    entropy = -sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url))
    assert got.entropy == pytest.approx(entropy)
    assert (got.depth, got.host_labels, got.parameters, got.hyphens, got.longest_segment, got.has_extension) == (2, 3, 2, 1, 7, 1)
    assert (got.tld, got.domain) == ("net", "net.c") and got.digit_ratio == pytest.approx(2 / len(url))


def _made(rng, spam):
    name = "".join(rng.choices("abcdefgh", k=rng.randint(4, 9)))
    if spam:
        return f"http://{name}{rng.randint(100, 99999)}.example.biz/{rng.randint(1, 9)}?id={rng.getrandbits(60)}&s={rng.getrandbits(40)}"
    return f"https://{name}.example.edu/{name}/{rng.choice(['index', 'about'])}.html"


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    known = [(_made(rng, k % 3 == 0), "block" if k % 3 == 0 else "allow") for k in range(300)]
    unseen = [(k, _made(rng, k % 2 == 0)) for k in range(100)]
    got = judge_urls(spark.createDataFrame(unseen, "page_id long, url string"), spark.createDataFrame(known, "url string, verdict string"), []).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) >= 97


def test_rule_names():
    assert split_rule("example.net/en/", "allow") == ("example.net", "/en/", "allow")
