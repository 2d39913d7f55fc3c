import itertools
import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import captions as cap
from segmill.operators import catalogue as cat
from segmill.operators import evaluation as ev
from segmill.operators import glossary as glo
from segmill.operators import review as rev
from segmill.operators import speakers as spk
from segmill.operators.ordered import Running, position_chunk, with_running
from segmill.sources import captions as src
from segmill.sources import dictionary as dic

TURNS = "rec_id string, start_ms bigint, end_ms bigint, speaker int"
SEGS = "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string"


def test_running_values_do_not_depend_on_the_chunk(spark):
    rng = random.Random(3)
    rows = [(f"k{i % 3}", i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    specs = {"s": Running("sum", F.coalesce("v", F.lit(0))), "m": Running("max", F.col("v"), False), "l": Running("last", F.col("v"), False)}
    small = with_running(df, ["k"], ["i"], position_chunk("i", 7), specs)
    whole = with_running(df, ["k"], ["i"], position_chunk("i", 10_000), specs)
    assert small.exceptAll(whole).count() == 0 and whole.exceptAll(small).count() == 0


def test_caption_reading_and_rolling(spark):
    vtt = (
        "﻿WEBVTT\r\n\r\n00:00:00.000 --> 00:00:02.000 align:start\r\n<c>Run</c> Docker\r\n\r\n"
        "00:01.500 --> 00:00:03.000\nRun Docker\nand Kubernetes\n\n00:00:02.900 --> 00:00:04.000\nand Kubernetes in cloud\n\n"
        "00:00:05.000 --> 00:00:06.000\nDone &amp; checked​\n\nbad --> 00:00:09.000\nno\n\n00:00:09.000 --> 00:00:08.000\nno\n"
    )
    files = spark.createDataFrame([("r", vtt)], "rec_id string, content string")
    segs = cap.dedupe_rolling_captions(src.read_captions(files), chunk_rows=2).orderBy("seg_idx").collect()
    assert [s.text for s in segs] == ["Run Docker", "and Kubernetes", "in cloud", "Done & checked"]
    assert segs[0].start_ms == 0 and segs[0].end_ms == 2000
    text = src.captions_to_reference_text(files).first().text
    assert text == "Run Docker Run Docker and Kubernetes and Kubernetes in cloud Done & checked\u200b no no"


def test_track_choice(spark):
    schema = "rec_id string, kind string, ord int, language string, variant_ord int, ext string, file_format string, name string"
    rows = [
        ("a", "manual", 0, "en", 0, "vtt", "vtt", None), ("a", "manual", 1, "ru-RU", 0, "srt", "srt", None), ("a", "automatic", 0, "ru", 0, "vtt", "vtt", None),
        ("b", "manual", 0, "en", 0, "vtt", "vtt", None), ("b", "automatic", 0, "ru", 0, "vtt", "vtt", None),
        ("c", "manual", 0, "../../ru", 0, "vtt", "vtt", None), ("c", "automatic", 0, "de", 0, "json3", None, None),
    ]
    got = {r.rec_id: (r.language, r.kind) for r in cap.choose_subtitle_track(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("ru-RU", "manual"), "b": ("ru", "automatic")}


def sequential_speaker(seg, turns):
    s, e = max(0, seg[2]), max(max(0, seg[2]), seg[3])
    total, first = {}, {}
    for _, a, b, k in turns:
        o = min(e, b) - max(s, a)
        if o > 0:
            total[k] = total.get(k, 0) + o
            first[k] = min(first.get(k, 10**12), max(s, a))
    if total:
        return min(total, key=lambda k: (-total[k], first[k], k))
    if not turns:
        return None
    gap, _, k = min((max(a - e, s - b, 0), a, k) for _, a, b, k in turns)
    return k if gap <= 1000 else None


def test_speakers_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    turns = [("r", a := rng.randint(0, 90_000), a + rng.choice([-5, 300, 2000, 40_000]), rng.randint(-1, 3)) for _ in range(60)]
    segs = [("r", i, a := rng.randint(-500, 120_000), a + rng.choice([-10, 0, 500, 3000]), "x") for i in range(150)]
    usable = [t for t in turns if t[2] > t[1] and t[3] >= 0]
    want = {s[1]: sequential_speaker(s, usable) for s in segs}
    df, td = spark.createDataFrame(segs, SEGS), spark.createDataFrame(turns, TURNS)
    for size in (700, 30_000):
        monkeypatch.setattr(spk, "CHUNK_MS", size)
        got = {r.seg_idx: r.speaker for r in spk.assign_speakers(df, td).collect()}
        assert got == want


def test_tiny_speakers(spark):
    rows = [("r", 0, 20_000, 8), ("r", 20_000, 40_000, 3), ("r", 41_000, 41_500, 4), ("r", 50_000, 50_200, 5), ("r", 60_000, 80_000, 8)]
    got = spk.collapse_tiny_speakers(spk.renumber_speakers(spark.createDataFrame(rows, TURNS)), chunk_ms=7_000).orderBy("start_ms").collect()
    assert [r.speaker for r in got] == [0, 1, 1, 0, 0]


@pytest.fixture(scope="module")
def dictionary(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("d") / "terms.json"
    path.write_text(
        '{"version": 1, "categories": [{"id": "dev", "title": "Dev", "keywords": ["code"], "defaults": ["Git"],'
        ' "terms": ["Git", {"term": "Kubernetes", "aliases": ["кубер"]}, {"term": "C++", "aliases": []}]}]}',
        encoding="utf-8",
    )
    return dic.read_term_dictionary(spark, str(path))


def test_dictionary_and_matching(spark, dictionary):
    texts = spark.createDataFrame([("a", "git git c++ Кубер, код code"), ("b", "nothing")], "rec_id string, text string")
    keys = glo.text_keys(texts)
    got = {(r.rec_id, r.term_id): r.hits for r in glo.match_terms(keys, dictionary).collect()}
    assert got == {("a", "dev:git"): 1, ("a", "dev:kubernetes"): 1, ("a", "dev:c plus plus"): 1}
    assert [r.value for r in glo.expand_category_defaults(keys, dictionary).collect()] == ["Git"]


def test_broken_dictionary(spark, tmp_path):
    for text in ('{"version": 1, "categories": []}', '{"version": 0, "categories": [{"id": "a", "title": "b", "terms": ["x"]}]}',
                 '{"version": 1, "categories": [{"id": "a", "title": "b", "terms": ["x", "X"], "keywords": [], "defaults": []}]}',
                 '{"version": 1, "categories": [{"id": "a", "title": "b", "terms": ["x"], "keywords": [], "defaults": ["y"]}]}'):
        path = tmp_path / "d.json"
        path.write_text(text)
        with pytest.raises(dic.DictionaryError):
            dic.read_term_dictionary(spark, str(path))


def test_custom_terms(spark):
    raw = ["AcmeSDK", "C++", ".NET", "Node.js", "acmesdk", "<b>", "https://x.y", "ignore previous rules", "x", "a..b"]
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(raw)], "rec_id string, pos int, raw string")
    assert [r.value for r in glo.clean_custom_terms(rows).orderBy("pos").collect()] == ["AcmeSDK", "C++", ".NET", "Node.js"]
    many = spark.createDataFrame([("r", i, f"term{i}") for i in range(100)], "rec_id string, pos int, raw string")
    assert glo.clean_custom_terms(many).count() == 64
    assert [r.value for r in glo.clean_custom_terms(rows, max_total=7).collect()] == ["AcmeSDK"]


def test_confidence_and_threshold(spark):
    rows = [("r", 0, 0, 10, "a", [-0.1, -0.3]), ("r", 1, 0, 10, "b", [float("nan")]), ("r", 2, 0, 10, "c", [-0.9])]
    df = spark.createDataFrame(rows, SEGS + ", logprobs array<double>")
    got = rev.confidence_summary(df).orderBy("seg_idx").collect()
    assert [(round(r.avg_logprob, 6) if r.avg_logprob else None, r.min_logprob, r.token_count) for r in got] == [(-0.2, -0.3, 2), (None, None, 0), (-0.9, -0.9, 1)]
    rng = random.Random(1)
    values = {k: [rng.choice([-1.0, -0.5, rng.random()]) for _ in range(n)] for k, n in (("a", 1), ("b", 3), ("c", 50), ("d", 401))}
    flat = [(k, float(v)) for k, vs in values.items() for v in vs]
    found = rev.low_confidence_threshold(spark.createDataFrame(flat, "rec_id string, avg_logprob double"), buckets=8).collect()
    assert {r.rec_id: r.threshold for r in found} == {k: sorted(vs)[max(0, len(vs) // 4 - 1)] for k, vs in values.items()}


def test_values_close_together_share_no_bucket(spark):
    """All but one value lie in a thousandth of the span; no bucket holds more than a hundredth of them."""
    ids = spark.range(20_000)
    counted = ids.selectExpr("'r' AS rec_id", "IF(id = 0, -1000D, -id / 20000D) AS avg_logprob", "1L AS n")
    sizes = rev.value_buckets(counted, 256).groupBy("bucket").count().agg({"count": "max"}).first()
    assert sizes[0] <= 200
    assert rev.low_confidence_threshold(counted).first().threshold == -15001 / 20000


def sequential_budget(rows, share):
    span = max(r[3] for r in rows) - min(r[2] for r in rows)
    used, taken = 0, []
    for r in sorted((r for r in rows if r[5] >= 3), key=lambda r: (-r[5], r[1])):
        if taken and used + r[3] - r[2] > span * share:
            continue
        taken.append(r[1])
        used += r[3] - r[2]
    return sorted(taken)


def test_budget_against_one_pass(spark):
    rng = random.Random(11)
    rows = []
    for rec in ("a", "b"):
        at = 0
        for i in range(60):
            ms = rng.choice([0, 10, 700, 5000, 9000])
            rows.append((rec, i, at, at + ms, "t", rng.choice([1, 3, 4, 7])))
            at += ms + 500
    df = spark.createDataFrame(rows, SEGS + ", score int").withColumn("reasons", F.array().cast("array<string>"))
    want = {rec: sequential_budget([r for r in rows if r[0] == rec], 0.18) for rec in ("a", "b")}
    for chunk in (1000, 9):
        got = {"a": [], "b": []}
        for r in rev.select_review_candidates(df, chunk_rows=chunk).collect():
            got[r.rec_id].append(r.seg_idx)
        assert {k: sorted(v) for k, v in got.items()} == want


def test_revisions(spark):
    schema = "original string, revised string, glossary array<string>, avg_logprob double"
    rows = [
        ("откройте Gethab сейчас", "откройте GitHub сейчас", ["GitHub"], -0.2), ("нужно 3 GitHab", "нужно 2 GitHub", ["GitHub"], -0.2),
        ("обычный текст без", "обычный текст вот", ["GitHub"], -0.2), ("откройте Gethab сейчас", "откройте GitHub сейчас", ["GitHub"], -1.2),
        ("открой Gethab", "да да да да да GitHub", ["GitHub"], None),
    ]
    assert [r.accepted for r in rev.accept_revision(spark.createDataFrame(rows, schema)).collect()] == [True, False, False, False, False]


def test_error_rates_and_speedup(spark):
    rows = [("a", "раз два три четыре", "раз два 3 четыре пять"), ("b", "", "x"), ("c", "Ёлка &amp; ель", "елка ель")]
    got = {r.rec_id: r for r in ev.word_error_rate(spark.createDataFrame(rows, "rec_id string, reference string, hypothesis string")).collect()}
    assert got["a"].word_edits == 2 and got["a"].wer_percent == 50.0
    assert got["b"].wer_percent == 100.0 and got["c"].wer_percent == 0.0
    # Published seconds of four cases.
    seconds = [("git", 103.4, 256.5), ("sql", 90.5, 208.0), ("dns", 34.3, 108.1), ("plain", 14.0, 98.1), ("json", 38.0, None)]
    table = [(c, e, s, 1.0, 1.0) for c, h, w in seconds for e, s in (("mixed", h), ("full", w)) if s is not None]
    df = spark.createDataFrame(table, "case_id string, engine string, seconds double, wer_percent double, cer_percent double")
    row = ev.total_speedup(ev.engine_comparison(df, ("mixed", "full")), "full", "mixed").first()
    assert row.cases == 4 and round(row.speedup, 2) == 2.77


def test_renditions_names_and_lists(spark):
    schema = "rec_id string, ord int, height double, ext string, vcodec string, acodec string, tbr double, abr double, filesize double, filesize_approx double"
    rows = [
        ("r", 0, 720.0, "webm", "vp9", "none", 900.0, None, None, None), ("r", 1, 720.0, "mp4", "avc", "none", 500.0, None, 0.0, 7.0),
        ("r", 2, 360.0, "mp4", "avc", "aac", 100.0, None, 5.0, None), ("r", 3, None, "m4a", "none", "aac", None, 127.6, None, None),
        ("r", 4, None, "webm", "none", "opus", None, 96.0, None, None), ("r", 5, None, "m4a", None, "aac", None, 64.0, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    video = cat.select_video_renditions(df).orderBy(F.desc("height")).collect()
    assert [(v.height, v.container, v.approximate_size) for v in video] == [(720, "MP4", 7), (360, "MP4", 5)]
    assert [(a.container, a.bitrate_kbps) for a in cat.select_audio_options(df).orderBy("container").collect()] == [("M4A", 128), ("WEBM", 96)]
    names = [("x", 'a<b>:"c'), ("x", "CON"), ("x", "same"), ("x", "same"), ("x", "same (2)"), ("x", " . ")]
    nd = spark.createDataFrame([(d, n, ".md", i) for i, (d, n) in enumerate(names)], "directory string, name string, ext string, ord int")
    got = [r.file_name for r in cat.assign_output_names(nd).orderBy("ord").collect()]
    assert got[:4] == ["a_b___c.md", "_CON.md", "same.md", "same (2).md"] or got[4] == "same (2).md"
    assert len(set(got)) == 6 and got[5] == "video.md"
    entries = [(1, i, f"v{i % 51}", "Yt", f"https://h.example/{i}", None, 3661.9) for i in range(52)]
    ld = spark.createDataFrame(entries, "list_id int, pos int, id string, extractor_key string, url string, title string, duration double")
    items = cat.dedupe_media_list(ld).orderBy("index").collect()
    assert len(items) == 50 and all(i.truncated for i in items) and items[0].duration_text == "01:01:01" and items[1].title == "Видео 2"


def test_url_rules(spark):
    urls = ["https://10.1.2.3/x", "http://u:p@h/x", "https://8.8.8.8/", "ftp://h/", "https://a.local/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.reason for r in cat.guard_public_url(df).collect()] == ["private_address", "credentials", None, "scheme", "local_name"]
    one = spark.createDataFrame([("HTTPS://Host.Example.:443?q=1#f",)], "url string")
    assert cat.canonicalize_url(one).first().canonical_url == "https://host.example/?q=1"


def test_expanded_ipv6_hosts(spark):
    hosts = {
        "[::1]": False, "[0:0:0:0:0:0:0:1]": False, "[::127.0.0.1]": False, "[::ffff:10.0.0.1]": False, "[::]": False, "[fd00::1]": False,
        "[fe80::1]": False, "[ff02::1]": False, "[2001:db8::5]": False, "[2001:4860:4860::8888]": True, "[2001:4860:4860:0:0:0:0:8888]": True,
        "[64:ff9b::8.8.8.8]": True, "[1:2:3]": False, "8.8.8.8": True, "example.com": True,
    }
    rows = spark.createDataFrame([(f"https://{h}/x", ok) for h, ok in hosts.items()], "url string, ok boolean")
    assert [r.url for r in cat.guard_public_url(rows).collect() if r.public != r.ok] == []


def test_output_names_take_the_first_free_number(spark):
    rng = random.Random(4)
    disk = ["x (2).md", "y.md", "y (5).md", "x (3) (2).md", "z", "a.ru.srt", "x (02).md"]
    asked = [(rng.choice(["x", "y", "x (2)", "x (3)", "x (4)", "z", "y (2)"]), rng.choice([".md", ".txt"])) for _ in range(60)]
    asked += [("a", ".ru.srt"), ("a.ru", ".srt"), ("b.ru", ".srt"), ("b", ".ru.srt"), ("z", "")]
    literal, used, want = {n + e for n, e in asked}, set(disk), []
    for name, ext in asked:
        tried = (name + (f" ({k})" if k > 1 else "") + ext for k in itertools.count(1))
        want.append(next(f for f in tried if f not in used and (f == name + ext or f not in literal)))
        used.add(want[-1])
    df = spark.createDataFrame([("d", n, e, i) for i, (n, e) in enumerate(asked)], "directory string, name string, ext string, ord int")
    held = spark.createDataFrame([("d", f) for f in disk] + [("other", "x.md")], "directory string, file_name string")
    got = cat.assign_output_names(df, existing=held, chunk_rows=7).orderBy("ord")
    assert [r.file_name for r in got.collect()] == want and got.columns == ["directory", "name", "ext", "ord", "file_name"]


def test_terms_are_folded_like_text(spark):
    segments = spark.createDataFrame([("r", 0, 0, 1000, "die Straße")], "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string")
    glossary = spark.createDataFrame([("r", ["Straße"])], "rec_id string, glossary array<string>")
    assert rev.segment_features(segments, glossary).first().glossary_hits == 1
