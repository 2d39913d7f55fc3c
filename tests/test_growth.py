"""Work that must not be repeated as tables grow."""

from pyspark.sql import functions as F

from segmill.sources import captions as src


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cue_parts_are_computed_once(spark):
    files = spark.createDataFrame([("a", "x")], "rec_id string, content string")
    plan = _plan(src.read_captions(files))
    assert plan.count("array_position(") == 1
    assert plan.count("split_part(") + plan.count("SplitPart") <= 2


def test_files_without_entities_stay_out_of_python(spark):
    cue = "00:01.000 --> 00:02.000\n"
    files = spark.createDataFrame([("a", f"WEBVTT\n\n{cue} a <b>&amp; b \n"), ("b", f"WEBVTT\n\n{cue}c  d"), ("c", None)], "rec_id string, content string")
    assert sorted((r.rec_id, r.start_ms, r.end_ms, r.text) for r in src.read_captions(files).collect()) == [("a", 1000, 2000, "a & b"), ("b", 1000, 2000, "c d")]
    told = {r.rec_id: r.text for r in src.captions_to_reference_text(files).collect()}
    assert told == {"a": "a & b", "b": "c  d", "c": None}
    assert "contains" in _plan(src.captions_to_reference_text(files)).lower()


def test_words_that_never_meet_send_no_places(spark):
    """Texts full of the words of two-word phrases, none of which occurs."""
    from segmill.operators import glossary as glo

    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda rows: sum(rows.apply(i).shuffleWriteBytes() for i in range(rows.size()))
    said = "abcdef"
    texts = [(str(k), " ".join(f"{said[(i * 7 + k + i // 5) % 6]} x{i}" for i in range(600))) for k in range(40)]
    phrases = spark.createDataFrame([(f"{a} {b}",) for a in said for b in said], "key string")
    before = written(stages())
    assert glo.match_phrases(spark.createDataFrame(texts, "rec_id string, key_text string"), phrases).count() == 0
    assert written(stages()) - before < 60_000


def test_keys_share_a_state(spark):
    """As many calls into Python as buckets, not as keys."""
    import datetime

    from segmill.streaming import ordered, runs, state

    rows = [(f"t{k % 40}", k, "update", "a", 1.0, None, datetime.datetime(2024, 1, 1, 0, k), 0) for k in range(60)]
    df = spark.createDataFrame(rows, "task_id string, seq bigint, kind string, stage string, progress double, details map<string,double>, ts timestamp, turn int")
    kept, ordered.BUCKETS = ordered.BUCKETS, 2
    try:
        out = runs.run_in_turns(df, "turn", 1, state.task_state_stream, "update")
    finally:
        ordered.BUCKETS = kept
    got = {r.task_id: r.last_seq for r in runs._newest(out, "task_id").collect()}
    assert got == {f"t{k}": k + 40 if k < 20 else k for k in range(40)}


def test_a_missing_glossary_entry_hides_no_words(spark):
    from segmill.operators import review as rev

    rows = [("a", 0, 0, 1000, "Git rare rare und git", ["git", "git", None]), ("b", 0, 0, 1000, "Git rare", None)]
    df = spark.createDataFrame(rows, "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, glossary array<string>")
    got = {r.rec_id: (r.glossary_hits, r.unknown_latin) for r in rev.segment_features(df).collect()}
    assert got == {"a": (4, 3), "b": (0, 2)}


def test_texts_are_cleaned_once_per_condition(spark):
    from segmill.functions.text import compact, strip
    from segmill.operators import segments as seg

    df = spark.createDataFrame([("a", 0, 0, 1, " ab ")], "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string")
    assert _plan(seg.clean_segments(df)).count("regexp_replace(") == 2
    letters = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    assert "translate(" not in _plan(letters.select(compact(F.col("c"))))
    kept = {chr(r.id): r.k for r in letters.select("id", compact(F.col("c")).alias("k")).filter("k != ''").collect()}
    plain = {c: c for c in "abcdefghijklmnopqrstuvwxyz0123456789" + "".join(map(chr, range(ord("а"), ord("я") + 1)))}
    assert kept == plain | {"ё": "е"}
    spaces = {chr(r.id) for r in letters.filter("c != ''").filter(strip(F.col("c")) == "").collect()}
    assert spaces == {chr(r.id) for r in letters.filter(F.col("c").rlike(r"(?U)^[\s\x1c-\x1f]$")).collect()}


def test_caption_tokens_are_compared_once(spark):
    from segmill.operators import captions as cap

    texts = ["a b c", "a b c", "b c d", "b c d e f", "b c", "c x", "word", "word y", "z", "p q p q", "p q r"]
    cues = spark.createDataFrame([("a", k, k * 1000, k * 1000 + 1010, t) for k, t in enumerate(texts)], "rec_id string, cue_idx int, start_ms bigint, end_ms bigint, text string")
    acted = cap.caption_actions(cues)
    got = [(r.action, r.new_text) for r in acted.orderBy("cue_idx").collect()]
    assert got == [
        ("new", "a b c"), ("same", ""), ("shifted", "d"), ("grown", "e f"), ("shrunk", ""), ("new", "c x"),
        ("new", "word"), ("grown", "y"), ("new", "z"), ("new", "p q p q"), ("shifted", "r"),
    ]
    assert _plan(acted).count("sequence(") == 1


def test_long_candidates_are_not_cleaned(spark):
    """What has too many plain letters or words stays out of the normaliser; what only looks long does not."""
    from segmill.operators import glossary as glo

    raws = ["one two three four five", "one two three four five six", "x" * 64, "x" * 65, "@ " * 80 + "kept" + " @" * 80, "\uff21" * 65, "a b c d e " + "@" * 90, "e\u0301" * 40]
    rows = spark.createDataFrame([("a", k, raw) for k, raw in enumerate(raws)], "rec_id string, pos int, raw string")
    got = [r.value for r in glo.clean_custom_terms(rows).orderBy("pos").collect()]
    assert got == ["one two three four five", "x" * 64, "kept", "a b c d e", "\u00e9" * 40]
    plan = _plan(glo.clean_custom_terms(rows))
    assert "[A-Za-z0-9][^ ]* " in plan and plan.count("(?U)[^") <= 4


def test_document_texts_move_once(spark):
    import hashlib

    from segmill.sinks import transcripts as out

    noise = lambda k: "".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(30))
    units = spark.createDataFrame([(f"r{k % 7}", "txt", k, noise(k)) for k in range(300)], "rec_id string, format string, unit bigint, text string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda rows: sum(rows.apply(i).shuffleWriteBytes() for i in range(rows.size()))
    start = written(stages())
    units.repartition(4, "rec_id").write.format("noop").mode("overwrite").save()
    once = written(stages()) - start
    out.document_parts(units, 100).write.format("noop").mode("overwrite").save()
    assert written(stages()) - start - once < 1.5 * once
    whole = {(r.rec_id, r.part): r.content for r in out.document_parts(units, 100).collect()}
    assert sorted(whole) == [(f"r{k}", p) for k in range(7) for p in range(3)]
    assert whole["r3", 0] + whole["r3", 1] + whole["r3", 2] == "\n\n".join(noise(k) for k in range(3, 300, 7)) + "\n"


def test_short_pairs_are_aligned_in_their_row(spark, monkeypatch):
    """Nothing is shuffled for short texts, and rows and joins agree, also where words and triples come again."""
    import random

    from segmill.operators import alignment as ali

    rng, rows = random.Random(9), [("r", 900, None, " y "), ("r", 901, "z z z", None), ("r", 902, "a A a a", "a a a a a")]
    for k in range(400):
        words = rng.choices("ab", k=rng.randint(0, 9)) + rng.sample([f"w{i}" for i in range(30)], rng.randint(0, 9))
        told = list(words)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(told))
            told[at : at + rng.randint(0, 2)] = rng.choices(["a", "b", "x,", "y y", "- "], k=rng.randint(0, 2))
        rows.append(("r", k, " ".join(words) + rng.choice(["", ".", " ?"]), rng.choice(["", "well, "]) + " ".join(told)))
    pairs = spark.createDataFrame(rows, "rec_id string, seg_idx int, original string, revised string").repartition(3)
    pairs.collect()
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = written()
    near = {r.seg_idx: r.aligned for r in ali.align_revision_boundaries(pairs).collect()}
    assert written() - before <= 2 * len(rows)  # the test's own repartition, read for short and for long ones
    monkeypatch.setattr(ali, "ROW_CHARS", -1)
    assert near == {r.seg_idx: r.aligned for r in ali.align_revision_boundaries(pairs).collect()}


def test_runs_of_a_row_are_those_of_the_joins(spark):
    import random

    from pyspark.sql import types as T

    from segmill.operators import alignment as ali

    rng, rows = random.Random(3), []
    for k in range(200):
        a = rng.choices("abcd", k=rng.randint(0, 14))
        rows.append((k, a, a[rng.randint(0, 3) : 11] + rng.choices("abcd", k=rng.randint(0, 5))))
    pairs = spark.createDataFrame(rows, "key int, original_words array<string>, revised_words array<string>")
    joined = ali.matching_runs(pairs, ["key"])
    inside = pairs.select("key", F.inline(ali.row_runs(F.col("original_words"), F.col("revised_words"))))
    told = lambda df: sorted((r.key, r.a, r.b, r["size"]) for r in df.collect())
    assert told(joined) == told(inside) and dict(inside.dtypes)["a"] == T.IntegerType().simpleString()
    chains = {r.key: tuple(r.c) for r in pairs.select("key", ali.chain_of(ali.row_runs(F.col("original_words"), F.col("revised_words"))).alias("c")).collect() if r.c}
    rows = ali._with_row_chain(pairs, "original_words", "revised_words").filter("_c IS NOT NULL")
    assert chains == {r.key: (r.a, r.b, r.a_end, r.b_end) for r in ali.heaviest_chain(joined, ["key"]).collect()}
    assert chains == {r.key: tuple(r["_c"]) for r in rows.collect()}


def test_folding_is_that_of_python_and_stays_in_the_jvm(spark):
    import unicodedata

    from segmill.functions.udfs import casefold, casefold_each

    letters = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c").filter("c != ''")
    folded = letters.select("id", casefold(F.col("c")).alias("f"), casefold_each(F.array("c", F.lit(None)))[0].alias("g"))
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()
    # Letters that Python does not know yet may fold.
    known = [r for r in folded.collect() if unicodedata.category(chr(r.id)) != "Cn"]
    assert len(known) > 280_000 and all(r.f == r.g == chr(r.id).casefold() for r in known)
    texts = ["ΣΑΣ Straße", "İı", "PLAIN", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, c string").select("id", casefold(F.col("c"))).collect()
    assert [v for _, v in sorted(rows)] == [t and t.casefold() for t in texts]


def test_features_are_made_in_the_jvm_by_one_pattern_a_glossary(spark):
    """Words with marks, terms in one another, copies, terms of several words, empty ones and none."""
    from segmill.operators import review as rev

    glossary = ["a", "ab", "AB", "ab cd", "x.y", "(", "", None, "Straße", "-go-", "tail\n", "c++"]
    texts = ["a AB abc ab. cd ab cd", "x.y (x.y) xy", "STRASSE straße", "go Go- go-x rare the it", "c++ c tail\n tail", None, "", "?"]
    columns = "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, glossary array<string>"
    rows = [(rec, k, 0, 1000, text, terms) for rec, terms in (("r", glossary), ("s", []), ("t", None)) for k, text in enumerate(texts)]
    df = spark.createDataFrame(rows, columns)
    made = rev.segment_features(df).select("rec_id", "seg_idx", "glossary_hits", "unknown_latin")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    none = F.array().cast("array<string>")
    terms = rev.casefold_each(F.filter(F.coalesce("glossary", none), F.isnotnull))
    plain = df.select(
        "rec_id", "seg_idx", rev.glossary_hits(rev.casefold(F.col("text")), terms), F.size(rev.unknown_latin(F.col("text"), F.col("glossary")))
    )
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))
    assert {(r.rec_id, r.seg_idx): r.glossary_hits for r in made.collect()}["r", 0] == 9


def test_a_figure_is_made_once_for_all_conditions_on_it(spark):
    from segmill.operators import review as rev

    rows = [("r", k, 0, 1000, f"t{k}", [-k / 10.0, float("nan"), None]) for k in range(9)] + [("s", 0, 0, 9, "x", [])]
    df = spark.createDataFrame(rows, "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, logprobs array<double>")
    summary = rev.confidence_summary(df)
    assert _plan(summary.filter("seg_idx > 3")).count("aggregate(") == 1
    for few in (100, 2):
        assert [tuple(r) for r in rev.low_confidence_threshold(summary, buckets=4, few=few).collect()] == [("r", -0.7)]


def test_caption_texts_move_once(spark):
    """Cues are sent to their chunk, and not at all where they lie by their recording; chunks of any size agree."""
    import random

    from segmill.operators import captions as cap

    rng, rows = random.Random(5), []
    for rec in range(6):
        text = "w0"
        for k in range(200):
            text = rng.choice([text, text, text, f"{text} w{k}", f"w{k} {rng.random()}", text.split(" ")[0], "", "..."])[-60:]
            rows.append((f"r{rec}", k, k * 1000, k * 1000 + rng.choice([700, 1010, 5000]), text))
    columns = "rec_id string, cue_idx int, start_ms bigint, end_ms bigint, text string"
    cues = spark.createDataFrame(rows, columns)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(stages().apply(i).shuffleWriteBytes() for i in range(stages().size()))
    start = written()
    dealt = cues.repartition(4, "rec_id")
    dealt.write.format("noop").mode("overwrite").save()
    once = written() - start
    told = sorted(map(tuple, cap.dedupe_rolling_captions(cues).collect()))
    assert written() - start - once < 1.8 * once and len(told) > 200
    start = written()
    assert sorted(map(tuple, cap.dedupe_rolling_captions(spark.createDataFrame(rows, columns).repartition(4, "rec_id")).collect())) == told
    assert written() - start < 2.6 * once  # the test's own repartition, read twice
    for size in (1, 3, 50):
        assert sorted(map(tuple, cap.dedupe_rolling_captions(cues, chunk_rows=size).collect())) == told
    assert {(r, i) for r, i, *_ in told} == {(f"r{rec}", i) for rec in range(6) for i in range(max(i for r, i, *_ in told if r == f"r{rec}") + 1)}


def test_caption_files_are_parsed_once(spark):
    from segmill.plans.transcripts import caption_transcripts

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    cue = "00:00:0{0}.000 --> 00:00:0{1}.500\nword{0} more\n"
    body = "WEBVTT\n\n" + "\n".join(cue.format(k, k + 1) for k in range(5))
    files = spark.createDataFrame([(f"r{k}", body) for k in range(7)], "rec_id string, content string").withColumn("content", counted("content"))
    assert {r.rec_id for r in caption_transcripts(files).collect()} == {f"r{k}" for k in range(7)}
    assert calls.value == 7


def test_plain_times_are_read_and_written_as_any(spark):
    from segmill.functions.times import PLAIN_TIMING, clock, parse_clock, plain_clock

    ends = ["00:00:01.000", "01:02:03,045", "99:59:59.999", "00:60:00.000", "00:00:60.000", "1:00:01.000", "00:01.000", "00:00:01.5", "٠٠:00:01.000"]
    lines = spark.createDataFrame([(f"{a} --> {b}", a, b) for a in ends for b in ends], "line string, a string, b string")
    plain = lines.filter(F.col("line").rlike(PLAIN_TIMING)).select(
        (plain_clock(F.col("line"), 1).eqNullSafe(parse_clock(F.col("a"))) & plain_clock(F.col("line"), 18).eqNullSafe(parse_clock(F.col("b")))).alias("same")
    )
    assert [r.same for r in plain.collect()] == [True] * 25
    assert lines.filter(F.concat("line", F.lit("\n")).rlike(PLAIN_TIMING)).isEmpty()
    times = [None, -5, 0, 999, 1000, 61_001, 3_599_999, 36_000_000, 360_000_000, 3_600_000_000_000]
    got = spark.createDataFrame([(t,) for t in times], "ms bigint").select("ms", clock(F.col("ms")), clock(F.col("ms"), ","))
    for ms, whole, exact in got.collect():
        ms = max(ms or 0, 0)
        assert whole == f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}" and exact == f"{whole},{ms % 1000:03d}"
    assert "format_string" not in _plan(got)


def test_normalising_is_that_of_python_and_stays_in_the_jvm(spark):
    import unicodedata

    from segmill.functions.udfs import nfkc, nfkc_casefold

    letters = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c").filter("c != ''")
    made = letters.select("id", nfkc(F.col("c")).alias("n"), nfkc_casefold(F.col("c")).alias("f"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    known = [r for r in made.collect() if unicodedata.category(chr(r.id)) != "Cn"]
    plain = {r.id: unicodedata.normalize("NFKC", chr(r.id)) for r in known}
    assert len(known) > 280_000 and all(r.n == plain[r.id] and r.f == plain[r.id].casefold() for r in known)
    texts = ["é 각 ﬁ ΑΣ", "Ạ̊", "PLAIN", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, c string").select("id", nfkc(F.col("c")), nfkc_casefold(F.col("c"))).collect()
    normal = [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert sorted(map(tuple, rows)) == [(i, n, n and n.casefold()) for i, n in enumerate(normal)]


def test_pairs_are_made_for_phrases_of_words_only(spark):
    from segmill.operators import glossary as glo

    texts = spark.createDataFrame([("a", "x y x x z x y z"), ("b", "z"), ("c", ""), (None, "x y z")], "rec_id string, key_text string")
    hits = lambda *keys: glo.match_phrases(texts, spark.createDataFrame([(k,) for k in keys], "key string"))
    told = lambda df: sorted(((r.rec_id or "", r.key, r.hits) for r in df.collect()))
    alone = hits("x", "z", "q")
    assert told(alone) == [("", "x", 1), ("", "z", 1), ("a", "x", 3), ("a", "z", 2), ("b", "z", 1)]
    assert _plan(alone).count("posexplode(") == 1
    assert told(hits("x", "x y")) == [("", "x", 1), ("", "x y", 1), ("a", "x", 3), ("a", "x y", 2)]
    assert told(hits("x", "x y", "x y z", "x y x x z x y z")) == [
        ("", "x", 1), ("", "x y", 1), ("a", "x", 3), ("a", "x y", 2), ("a", "x y x x z x y z", 1), ("a", "x y z", 1)
    ]


def test_documents_keep_all_partitions_and_their_segments_lie_by_recording(spark, tmp_path):
    from segmill.plans import views as v

    docs = [(k, f"a b c {k} " * 9, "en", "s", 1) for k in range(50)] + [(None, "x", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    segments = v.segments(spark, str(tmp_path))
    lie = segments.groupBy("rec_id", F.spark_partition_id().alias("p")).count().groupBy("p").count().collect()
    assert len(lie) == 4 and sum(r["count"] for r in lie) == 51
    counted = segments.groupBy("rec_id").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
