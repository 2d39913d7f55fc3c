"""The test tables seen as transcripts, turns, captions, catalogues and event logs.

These are stand-ins with the right shape: their values follow from the tables by
arithmetic and say nothing about speech quality. ``ORACLE`` holds the same views in
the checking engine's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions.arrays import let
from segmill.functions.times import clock

WORDS_PER_SEGMENT = 8
WORDS_PER_CUE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    # Dealt anew: the heavy work per document below must not depend on how the table was cut into files.
    # By the id as the views have it, so what they make of a document need not move to meet other rows of it; and into
    # all partitions, for their sizes tell little of the rows to come, which would not fit a few tasks.
    if name == "documents":
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").cast("string"))
    return df


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), " ")


def _run(words: Column, start: Column, n: int) -> Column:
    # Word by word: a slice copies the whole list, so a text's runs would cost the square of its length.
    return F.when(words.isNotNull(), F.concat_ws(" ", *[F.get(words, start + k - 1) for k in range(n)]))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight words a segment, two alternating speakers, pauses at fixed positions."""
    docs = table(spark, sf_dir, "documents")
    n = lambda w: F.greatest(F.lit(1), F.ceil(F.size(w) / WORDS_PER_SEGMENT)).cast("int")
    # Runs are cut inside the row; exploding the word list with each run would copy it every time.
    runs = let(
        _words(F.col("text")),
        lambda w: F.transform(
            F.sequence(F.lit(0), n(w) - 1), lambda i: _run(w, i * WORDS_PER_SEGMENT + 1, WORDS_PER_SEGMENT)
        ),
    )
    parts = docs.select("doc_id", F.col("doc_id").cast("string").alias("rec_id"), F.posexplode(runs).alias("i", "text"))
    text = F.col("text")
    timed = parts.select(
        "rec_id",
        F.col("i").alias("seg_idx"),
        text.alias("text"),
        (F.floor(F.col("i") / 20) % 2).cast("int").alias("speaker"),
        (F.length(text) * (40 + 60 * (F.col("doc_id") % 3))).cast("bigint").alias("dur"),
        F.when(F.col("i") % 35 == 34, 3000).when(F.col("i") % 5 == 1, 600).otherwise(100).alias("gap"),
    )
    # All rows of a document came from one row just above.
    before = Window.partitionBy("rec_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)).cast("bigint")
    return timed.withColumn("start_ms", start).select(
        "rec_id",
        "seg_idx",
        "start_ms",
        (F.col("start_ms") + F.col("dur")).alias("end_ms"),
        "text",
        F.col("speaker").cast("string").alias("speaker"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns near the segments: shifted, overlapping, missing and tiny ones."""
    seg = segments(spark, sf_dir).select(
        "rec_id", "seg_idx", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("dur"),
        F.col("speaker").cast("int").alias("speaker"),
    )
    i, start, dur = F.col("seg_idx"), F.col("start_ms"), F.col("dur")
    half = F.floor(dur / 2)
    tiny, split = i % 17 == 16, i % 13 == 12
    heard = (i % 11 != 10) & ~(i % 35).isin(32, 33)
    # The turns of a segment are made in its row, so the segments are made once.
    turn = lambda begin, end, speaker: F.struct(
        begin.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), speaker.cast("int").alias("speaker")
    )
    main = turn(
        F.when(tiny | split, start).otherwise(start + 400 * (i % 2)),
        F.when(tiny, start + 300).when(split, start + half).otherwise(start + dur + 50),
        F.when(tiny, 2 + i % 2).otherwise(F.col("speaker")),
    )
    other = 1 - F.col("speaker")
    made = F.array(
        F.when(heard, main),
        F.when(split & heard, turn(start + half, start + dur, other)),
        F.when(i % 13 == 6, turn(start, start + dur, other)),
    )
    return seg.select("rec_id", F.inline(made)).filter("end_ms > start_ms")


def _cue_text(w: Column, i: Column) -> Column:
    later = i > 0
    return (
        F.when(later & (i % 9 == 8), _run(w, i * 4 - 3, 8))
        .when(later & (i % 7 == 6), _run(w, i * 4 - 3, 4))
        .when(later & (i % 11 == 10), _run(w, i * 4 - 3, 12))
        .otherwise(_run(w, i * 4 + 1, 8))
    )


def _cue_numbers(w: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.size(w) / WORDS_PER_CUE).cast("int") - 1)


def _cue_end(i: Column) -> Column:
    return i * 1000 + F.when(i % 13 == 12, 700).otherwise(1010)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling captions: one cue a second over a sliding run of words."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("i")
    texts = let(
        _words(F.col("text")), lambda w: F.transform(_cue_numbers(w), lambda k: _cue_text(w, k))
    )
    return docs.select("doc_id", F.posexplode(texts).alias("i", "text")).select(
        F.col("doc_id").cast("string").alias("rec_id"),
        i.alias("cue_idx"),
        (i * 1000).cast("bigint").alias("start_ms"),
        _cue_end(i).cast("bigint").alias("end_ms"),
        "text",
    )


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues as one VTT text per document, made inside the document's row."""
    docs = table(spark, sf_dir, "documents")
    block = lambda w, i: F.concat(
        clock(i * 1000, "."), F.lit(" --> "), clock(_cue_end(i), "."), F.lit("\n"), _cue_text(w, i)
    )
    body = let(
        _words(F.col("text")),
        lambda w: F.array_join(F.transform(_cue_numbers(w), lambda i: block(w, i)), "\n\n"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("rec_id"), F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n")).alias("content")
    )


def asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with log-probabilities derived from the text length."""
    length = F.length("text")
    logprobs = F.transform(F.sequence(F.lit(1), 1 + length % 5), lambda i: -((length * i) % 100) / F.lit(100.0))
    return segments(spark, sf_dir).withColumn("logprobs", logprobs)


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as media formats of their order."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    line = F.col("l_linenumber") % 4
    video = F.col("l_returnflag") != "N"
    ext = (
        F.when(F.col("l_returnflag") == "R", "mp4")
        .when(F.col("l_returnflag") == "A", "webm")
        .when(F.col("l_linenumber") % 2 == 0, "m4a")
        .otherwise("webm")
    )
    return li.select(
        F.col("l_orderkey").cast("string").alias("rec_id"),
        F.row_number().over(order).alias("ord"),
        F.when(line == 0, 360).when(line == 1, 480).when(line == 2, 720).otherwise(1080).cast("double").alias("height"),
        ext.alias("ext"),
        F.when(video, "avc1").otherwise("none").alias("vcodec"),
        F.when(F.col("l_linestatus") == "O", "none").otherwise("mp4a").alias("acodec"),
        F.col("l_quantity").alias("tbr"),
        F.col("l_quantity").alias("abr"),
        F.floor("l_extendedprice").cast("double").alias("filesize"),
        F.lit(None).cast("double").alias("filesize_approx"),
    )


def request_events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as web traffic of a tab (the user); errors are page changes."""
    events = read(spark, sf_dir, "events")
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    joined = events.withColumn("page_id", F.get_json_object("props", "$.k").cast("bigint")).join(pages, "page_id")
    kind = F.col("event_type")
    file = (
        F.when(kind == "view", "/master.m3u8")
        .when(kind == "click", "/seg.mp4")
        .when(kind == "purchase", "/audio.m4a")
        .when(kind == "signup", "/manifest.mpd")
    )
    host = F.concat(F.lit("https://cdn"), (F.col("page_id") % 5).cast("string"), F.lit(".example.com/"), kind)
    url = F.when(kind == "error", F.col("page_url")).otherwise(F.concat(host, file))
    content_type = (
        F.when(kind == "view", "application/vnd.apple.mpegurl")
        .when(kind == "click", "video/mp4")
        .when(kind == "purchase", "audio/mp4")
        .when(kind == "signup", "application/dash+xml")
        .otherwise("text/html")
    )
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array(
        header("User-Agent", F.concat(F.lit("agent/"), F.col("page_id").cast("string"))),
        header("COOKIE", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c="), F.col("event_id").cast("string"))).otherwise("")),
        header("X-Trace", F.col("event_type")),
        header("origin", F.when(F.col("event_id") % 7 == 0, F.lit("a\nb")).otherwise(F.lit("https://site.example"))),
    )
    return joined.select(
        F.col("user_id").alias("tab_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("request_id"),
        F.when(kind == "error", "reset").otherwise("candidate").alias("kind"),
        url.alias("url"),
        "page_url",
        content_type.alias("content_type"),
        headers.alias("headers"),
        "ts",
    )


def task_events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as job progress: ``error`` is a cancel request in every 29th row, a failure in every 31st."""
    events = read(spark, sf_dir, "events")
    i = F.col("event_id")
    error = F.col("event_type") == "error"
    kind = (
        F.when(error & (i % 29 == 0), "cancel").when(error & (i % 31 == 0), "failed")
        .when((F.col("event_type") == "purchase") & (i % 37 == 0), "completed").otherwise("update")
    )
    details = F.when(
        i % 3 == 0,
        F.map_from_arrays(
            F.array(F.lit("downloaded_bytes")), F.array(F.when(i % 15 == 0, F.lit(None).cast("double")).otherwise(F.col("value") * 100))
        ),
    )
    return events.select(
        F.col("user_id").cast("string").alias("task_id"),
        i.alias("seq"),
        kind.alias("kind"),
        F.col("event_type").alias("stage"),
        (F.col("value") / 5).alias("progress"),
        details.cast("map<string,double>").alias("details"),
        "ts",
    )


def arriving_task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task events with the ``turn`` (third of the whole time) they arrive in: some minutes late, a few of them days late."""
    events = task_events(spark, sf_dir)
    i = F.col("seq")
    late = F.when(i % 41 == 0, F.expr("interval 12 days")).when(i % 3 == 0, F.expr("interval 9 minutes"))
    arrives = F.unix_micros(F.col("ts") + F.coalesce(late, F.expr("interval 0 minutes")))
    span = events.agg(F.unix_micros(F.min("ts")).alias("begin"), F.unix_micros(F.max("ts")).alias("end")).first()
    third = (span["end"] - span["begin"]) // 3 if span["end"] is not None else 0
    begin = span["begin"] or 0
    turn = F.when(arrives < begin + third, 0).when(arrives < begin + 2 * third, 1).otherwise(2)
    return events.withColumn("turn", turn)


def job_events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as a job log: a few jobs per user, created, patched, cancelled, deleted."""
    events = read(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    job = F.concat(F.lit("j"), (F.get_json_object("props", "$.k").cast("bigint") % 14).cast("string"))
    op = F.when(kind == "signup", "create").when((kind == "error") & (i % 3 == 0), "delete").otherwise("patch")
    stage = F.when((kind == "error") & (i % 3 != 0), "cancelling").when(kind == "purchase", F.lit(None).cast("string")).otherwise(kind)
    task = F.when(i % 4 == 0, F.concat(F.lit("t"), i.cast("string")))
    # Absent keys stay absent: only non-null fields enter the patch.
    field = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    fields = F.array(
        field("stage", stage),
        field("task_id", task),
        field("status", F.when(kind == "click", "running")),
        field("progress", F.when(kind == "view", F.floor("value"))),
    )
    patch = F.map_from_entries(F.filter(fields, lambda f: f["value"].isNotNull()))
    return events.select(
        F.col("user_id").cast("string").alias("owner"), job.alias("job_id"), i.alias("seq"), op.alias("kind"),
        F.unix_millis("ts").alias("created_at"), patch.alias("patch"), "ts",
    )


def media_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as list entries; every third comes again with another spelling of its URL."""
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("list_id"), "page_id", "url")
    again = pages.filter(F.col("page_id") % 3 == 0).select(
        "list_id", (F.col("page_id") + 1_000_000_000).alias("page_id"),
        F.concat(
            F.regexp_extract("url", r"^([a-z]+://)", 1), F.upper(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)),
            F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("#x"),
        ).alias("url"),
    )
    none = F.lit(None).cast("string")
    return pages.unionByName(again).select(
        "list_id", F.col("page_id").alias("pos"), none.alias("id"), none.alias("extractor_key"), "url",
        F.when(F.col("page_id") % 4 != 0, F.concat(F.lit(" page  "), F.col("page_id").cast("string"))).alias("title"),
        F.when(F.col("page_id") % 6 != 0, (F.col("page_id") % 10_000) + 0.5).alias("duration"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages against a copy that lost every 7th word and has ``x`` for every 11th."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text", _words(F.col("text")).alias("w"))
    marked = F.transform("w", lambda w, i: F.when((i + 1) % 7 == 0, "").when((i + 1) % 11 == 0, "x").otherwise(w))
    return bench.select(
        F.col("item_id").cast("string").alias("rec_id"),
        F.col("text").alias("reference"),
        F.array_join(F.filter(marked, lambda w: w != ""), " ").alias("hypothesis"),
    )


def traffic(spark: SparkSession, sf_dir: str, read=table) -> tuple[DataFrame, DataFrame]:
    """Requests, and responses minutes later; every tenth response comes too late to match."""
    from segmill.operators.requests import scrubbed_headers

    events = request_events(spark, sf_dir, read).filter("kind = 'candidate'")
    requests = events.select("request_id", "ts", scrubbed_headers(F.col("headers")).alias("headers"))
    late = F.when(F.col("seq") % 10 == 0, F.expr("interval 20 minutes")).otherwise(F.expr("interval 2 minutes"))
    responses = events.select("tab_id", "seq", "request_id", "url", "content_type", (F.col("ts") + late).alias("ts"))
    return requests, responses


def submissions(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as task submissions; views carry no client id, the others share ids."""
    events = read(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("r"), key.cast("string"))).alias("client_request_id"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("task_id"),
        "ts",
    )


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extractor metadata: one JSON text per recording."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    words = _words(F.col("text"))
    variant = lambda ext, url, name: F.struct(
        F.lit(ext).alias("ext"), F.lit(url).alias("url"), name.alias("name")
    )
    manual = F.when(
        i % 3 == 0,
        F.map_from_arrays(
            F.array(F.col("lang"), F.lit("../../bad")),
            F.array(
                F.array(variant("json3", None, F.lit(None).cast("string")), variant("vtt", "u", F.col("source"))),
                F.array(variant("vtt", None, F.lit("x"))),
            ),
        ),
    )
    automatic = F.map_from_arrays(
        F.array(F.when(i % 2 == 0, "en-US").otherwise("de"), F.lit("ru_RU")),
        F.array(
            F.array(variant(None, "https://h/x/cap.SRT?y", F.lit("auto"))),
            F.when(i % 5 == 0, F.array(variant("srt", None, F.lit(None).cast("string")), variant("vtt", None, F.lit("ru")))).otherwise(
                F.array(variant("ttml", None, F.lit("no")))
            ),
        ),
    )
    info = F.struct(
        F.when(i % 4 != 0, F.array_join(F.slice(words, 1, 6), " ")).alias("title"),
        F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("channel"),
        F.concat(F.lit("up "), F.col("lang")).alias("uploader"),
        F.when(i % 7 != 0, F.col("n_chars") + 0.9).alias("duration"),
        F.col("text").alias("description"),
        F.slice(words, 7, 4).alias("tags"),
        F.array("lang").alias("categories"),
        manual.alias("subtitles"),
        automatic.alias("automatic_captions"),
    )
    return docs.select(i.cast("string").alias("rec_id"), F.to_json(info).alias("json"))


def dictionary_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Benchmark passages as a dictionary in four categories: each two words in turn are a term, with their swap
    as an alias, the first term of a passage also has the whole passage as an alias; every word is a keyword, the
    earliest term of a category its default."""
    from segmill.functions.text import term_key

    bench = table(spark, sf_dir, "benchmark").select("item_id", _words(F.col("text")).alias("w"))
    bench = bench.withColumn("category", F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")))
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(2))
    cut = bench.filter(F.size("w") > 0).select("item_id", "category", "w", F.explode(starts).alias("k"))
    pair = lambda a, b: F.concat_ws(" ", F.get("w", F.col("k") + a), F.get("w", F.col("k") + b))
    rows = cut.select(
        (F.col("item_id") * 10_000 + F.col("k")).alias("pos"),
        "category",
        pair(0, 1).alias("value"),
        F.filter(F.array(pair(1, 0), F.when(F.col("k") == 0, F.array_join("w", " "))), lambda x: x.isNotNull()).alias("aliases"),
    )
    first = rows.withColumn("key", term_key(F.col("value"))).filter("key != ''").groupBy("key").agg(
        F.min_by(F.struct("pos", "category", "value", "aliases"), "pos").alias("t")
    )
    terms = first.select("t.category", "t.pos", "t.value", "t.aliases")
    said = bench.select("category", "item_id", F.posexplode("w").alias("k", "keyword"))
    said = said.withColumns({"pos": F.col("item_id") * 10_000 + F.col("k"), "key": term_key(F.col("keyword"))}).filter("key != ''")
    return {
        "categories": terms.select(F.col("category").alias("id"), F.concat(F.lit("Category "), "category").alias("title")).distinct(),
        "terms": terms,
        "keywords": said.groupBy("category", "key").agg(F.min("pos").alias("pos"), F.min_by("keyword", "pos").alias("keyword")).drop("key"),
        "defaults": terms.groupBy("category").agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value")),
    }


# The same views for the checking engine. Each depends on the ones before it.
ORACLE = {
    "words": r"""
SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM documents""",
    "seg0": """
SELECT doc_id, i AS seg_idx, array_to_string(w[8*i+1:8*i+8], ' ') AS text, (i // 20) % 2 AS speaker,
  length(array_to_string(w[8*i+1:8*i+8], ' ')) * (40 + 60 * (doc_id % 3)) AS dur,
  CASE WHEN i % 35 = 34 THEN 3000 WHEN i % 5 = 1 THEN 600 ELSE 100 END AS gap
FROM (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil(len(w) / 8.0) AS BIGINT)))) AS i FROM words)""",
    "v_segments": """
SELECT CAST(doc_id AS VARCHAR) AS rec_id, CAST(seg_idx AS INTEGER) AS seg_idx, CAST(start_ms AS BIGINT) AS start_ms,
  CAST(start_ms + dur AS BIGINT) AS end_ms, text, CAST(speaker AS VARCHAR) AS speaker
FROM (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY doc_id ORDER BY seg_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms FROM seg0)""",
    "turn0": """
SELECT rec_id, seg_idx, start_ms, end_ms - start_ms AS dur, CAST(speaker AS INTEGER) AS speaker FROM v_segments""",
    "v_turns": """
SELECT rec_id, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, CAST(sp AS INTEGER) AS speaker FROM (
  SELECT rec_id,
    CASE WHEN seg_idx % 17 = 16 OR seg_idx % 13 = 12 THEN start_ms ELSE start_ms + 400 * (seg_idx % 2) END AS s,
    CASE WHEN seg_idx % 17 = 16 THEN start_ms + 300 WHEN seg_idx % 13 = 12 THEN start_ms + dur // 2
         ELSE start_ms + dur + 50 END AS e,
    CASE WHEN seg_idx % 17 = 16 THEN 2 + seg_idx % 2 ELSE speaker END AS sp
  FROM turn0 WHERE seg_idx % 11 <> 10 AND seg_idx % 35 NOT IN (32, 33)
  UNION ALL
  SELECT rec_id, start_ms + dur // 2, start_ms + dur, 1 - speaker FROM turn0
  WHERE seg_idx % 13 = 12 AND seg_idx % 11 <> 10 AND seg_idx % 35 NOT IN (32, 33)
  UNION ALL
  SELECT rec_id, start_ms, start_ms + dur, 1 - speaker FROM turn0 WHERE seg_idx % 13 = 6
) WHERE e > s""",
    "v_cues": """
SELECT CAST(doc_id AS VARCHAR) AS rec_id, CAST(i AS INTEGER) AS cue_idx, CAST(i * 1000 AS BIGINT) AS start_ms,
  CAST(i * 1000 + CASE WHEN i % 13 = 12 THEN 700 ELSE 1010 END AS BIGINT) AS end_ms,
  array_to_string(CASE WHEN i > 0 AND i % 9 = 8 THEN w[4*i-3:4*i+4] WHEN i > 0 AND i % 7 = 6 THEN w[4*i-3:4*i]
    WHEN i > 0 AND i % 11 = 10 THEN w[4*i-3:4*i+8] ELSE w[4*i+1:4*i+8] END, ' ') AS text
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 4.0) AS BIGINT))) AS i FROM words)""",
    "v_asr": """
SELECT *, list_transform(range(1, 2 + length(text) % 5), lambda i: -((length(text) * i) % 100) / 100.0::DOUBLE) AS logprobs
FROM v_segments""",
    "v_formats": """
SELECT CAST(l_orderkey AS VARCHAR) AS rec_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)
    AS INTEGER) AS ord,
  CASE l_linenumber % 4 WHEN 0 THEN 360 WHEN 1 THEN 480 WHEN 2 THEN 720 ELSE 1080 END AS height,
  CASE WHEN l_returnflag = 'R' THEN 'mp4' WHEN l_returnflag = 'A' THEN 'webm' WHEN l_linenumber % 2 = 0 THEN 'm4a'
    ELSE 'webm' END AS ext,
  CASE WHEN l_returnflag <> 'N' THEN 'avc1' ELSE 'none' END AS vcodec,
  CASE WHEN l_linestatus = 'O' THEN 'none' ELSE 'mp4a' END AS acodec,
  l_quantity AS tbr, l_quantity AS abr, CAST(floor(l_extendedprice) AS BIGINT) AS filesize
FROM lineitem""",
    "v_requests": """
SELECT user_id AS tab_id, event_id AS seq, CAST(event_id AS VARCHAR) AS request_id, event_type,
  CASE WHEN event_type = 'error' THEN 'reset' ELSE 'candidate' END AS kind,
  CASE event_type WHEN 'error' THEN url
    WHEN 'view' THEN 'https://cdn' || (page_id % 5) || '.example.com/view/master.m3u8'
    WHEN 'click' THEN 'https://cdn' || (page_id % 5) || '.example.com/click/seg.mp4'
    WHEN 'purchase' THEN 'https://cdn' || (page_id % 5) || '.example.com/purchase/audio.m4a'
    ELSE 'https://cdn' || (page_id % 5) || '.example.com/signup/manifest.mpd' END AS url,
  url AS page_url,
  CASE event_type WHEN 'view' THEN 'application/vnd.apple.mpegurl' WHEN 'click' THEN 'video/mp4'
    WHEN 'purchase' THEN 'audio/mp4' WHEN 'signup' THEN 'application/dash+xml' ELSE 'text/html' END AS content_type,
  page_id, ts
FROM (SELECT e.*, p.page_id, p.url FROM events e JOIN pages p
  ON CAST(json_extract_string(e.props, '$.k') AS BIGINT) = p.page_id)""",
    "v_task_events": """
SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq,
  CASE WHEN event_type = 'error' AND event_id % 29 = 0 THEN 'cancel' WHEN event_type = 'error' AND event_id % 31 = 0 THEN 'failed'
    WHEN event_type = 'purchase' AND event_id % 37 = 0 THEN 'completed' ELSE 'update' END AS kind,
  event_type AS stage, value / 5 AS progress, event_id % 3 = 0 AS has_bytes,
  CASE WHEN event_id % 15 = 0 THEN NULL ELSE value * 100 END AS bytes, ts
FROM events""",
    "v_media_list": r"""
SELECT page_id % 5 AS list_id, page_id AS pos, url FROM pages
UNION ALL
SELECT page_id % 5, page_id + 1000000000, regexp_extract(url, '^([a-z]+://)', 1)
  || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) || '#x'
FROM pages WHERE page_id % 3 = 0""",
    "v_pairs": r"""
SELECT CAST(item_id AS VARCHAR) AS rec_id, text AS reference,
  array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN i % 7 = 0 THEN '' WHEN i % 11 = 0 THEN 'x' ELSE x END),
    lambda x: x <> ''), ' ') AS hypothesis
FROM (SELECT item_id, text, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM benchmark)""",
    "doc_keys": r"""
SELECT CAST(doc_id AS VARCHAR) AS rec_id,
  trim(regexp_replace(replace(replace(replace(lower(text), 'ß', 'ss'), '+', ' plus '), '#', ' sharp '),
    '[^\p{L}\p{N}_]+', ' ', 'g')) AS key_text FROM documents""",
    "bench_words": r"""
SELECT item_id, 'c' || (item_id % 4) AS category, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM benchmark""",
    "bench_rows": r"""
SELECT item_id * 10000 + k AS pos, category, concat_ws(' ', w[k + 1], w[k + 2]) AS value, concat_ws(' ', w[k + 2], w[k + 1]) AS alias,
  CASE WHEN k = 0 THEN array_to_string(w, ' ') END AS passage
FROM (SELECT *, unnest(range(0, len(w), 2)) AS k FROM bench_words)""",
    "dict_terms": r"""
SELECT category, pos, value, alias, passage, category || ':' || key AS term_id FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rn FROM (
    SELECT *, trim(regexp_replace(replace(replace(replace(lower(value), 'ß', 'ss'), '+', ' plus '), '#', ' sharp '),
      '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM bench_rows) WHERE key <> '') WHERE rn = 1""",
    "dict_variants": r"""
SELECT DISTINCT term_id, key FROM (SELECT term_id, trim(regexp_replace(replace(replace(replace(lower(v), 'ß', 'ss'), '+', ' plus '), '#', ' sharp '),
      '[^\p{L}\p{N}_]+', ' ', 'g')) AS key
  FROM (SELECT term_id, unnest([value, alias, passage]) AS v FROM dict_terms) WHERE v IS NOT NULL) WHERE key <> ''""",
    "dict_keywords": r"""
SELECT category, key, min(pos) AS pos FROM (SELECT category, item_id * 10000 + k - 1 AS pos, trim(regexp_replace(replace(replace(replace(lower(word), 'ß', 'ss'), '+', ' plus '), '#', ' sharp '),
      '[^\p{L}\p{N}_]+', ' ', 'g')) AS key
  FROM (SELECT *, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM bench_words)) WHERE key <> '' GROUP BY category, key""",
}


def phrase_hits(name: str, texts: str, phrases: str) -> str:
    """Tables that end in ``name(rec_id, key, hits)``: the keys of ``phrases`` in the texts ``rec_id, key_text``.

    Phrases of one and two words are found by equality with word runs, longer ones by search;
    the hits of what is found are counted in the text.
    """
    return f"""{name}_words AS MATERIALIZED (SELECT rec_id, string_split(key_text, ' ') AS w FROM {texts} WHERE key_text <> ''),
{name}_keys AS MATERIALIZED (SELECT DISTINCT key, len(string_split(key, ' ')) AS n FROM {phrases}),
{name}_runs AS MATERIALIZED (SELECT DISTINCT rec_id, key FROM (
  SELECT rec_id, unnest(w) AS key FROM {name}_words
  UNION ALL SELECT rec_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words)
  WHERE key IN (SELECT key FROM {name}_keys WHERE n <= 2)),
{name}_found AS MATERIALIZED (SELECT rec_id, key FROM {name}_runs
  UNION ALL SELECT rec_id, key FROM {texts} JOIN {name}_keys ON contains(' ' || key_text || ' ', ' ' || key || ' ') WHERE n > 2),
{name} AS MATERIALIZED (SELECT rec_id, key, (length(' ' || key_text || ' ') - length(replace(' ' || key_text || ' ', ' ' || key || ' ', '')))
    // (length(key) + 2) AS hits FROM {name}_found JOIN {texts} USING (rec_id))"""


NEEDS = {
    "seg0": ("words",),
    "v_segments": ("seg0",),
    "turn0": ("v_segments",),
    "v_turns": ("turn0",),
    "v_cues": ("words",),
    "v_asr": ("v_segments",),
    "bench_rows": ("bench_words",),
    "dict_terms": ("bench_rows",),
    "dict_variants": ("dict_terms",),
    "dict_keywords": ("bench_words",),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views and all they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    body = ",\n".join(f"{name} AS MATERIALIZED ({ORACLE[name].strip()})" for name in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
