"""One query per operator over the test tables; every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import alignment as ali
from segmill.operators import captions as cap
from segmill.operators import catalogue as cat
from segmill.operators import evaluation as ev
from segmill.operators import glossary as glo
from segmill.operators import requests as req
from segmill.operators import review as rev
from segmill.operators import segments as seg
from segmill.operators import speakers as spk
from segmill.operators import tasks as tsk
from segmill.plans import views as v
from segmill.session import checkpointed, new_place
from segmill.sinks import transcripts as out
from segmill.sources import captions as src
from segmill.sources import dictionary as dic
from segmill.sources import metadata as meta
from segmill.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]

# Review patterns that fit the invented vocabulary of the test documents.
TEST_RULES = rev.ReviewRules(
    suspicious_latin=r"(?iuU)\b(?:the|der|que|con)\b",
    suspicious_term=r"(?iuU)\b(?:and|und|les|el)\b",
    technical_context=r"(?iuU)\b(?:is|ist|dans|por)\b",
    pronunciations={"the": ("that", "thou"), "der": ("die",), "le": ("la", "les")},
    stop_words=("and", "or", "the", "this"),
    safe_words=("it", "id"),
)


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# --- sources and sinks ----------------------------------------------------------------


def read_captions(spark, d):
    return src.read_captions(v.caption_files(spark, d)).select(
        "rec_id", _long("cue_idx"), "start_ms", "end_ms", "text"
    )


def captions_reference_text(spark, d):
    return src.captions_to_reference_text(v.caption_files(spark, d))


def _parsed(spark, d):
    return meta.parse_media_metadata(v.metadata_json(spark, d))


def read_media_recordings(spark, d):
    return meta.recordings(_parsed(spark, d)).select("rec_id", "title", "author", "duration_s", "duration_text")


def read_media_tracks(spark, d):
    return meta.tracks(_parsed(spark, d)).select(
        "rec_id", "kind", _long("ord"), "language", _long("variant_ord"), "ext", "file_format", "name"
    )


def _dictionary(spark, d):
    return dic.check_dictionary(**v.dictionary_rows(spark, d))


def read_term_dictionary(spark, d):
    made = _dictionary(spark, d)
    return made.terms.join(made.variants, "term_id").select("term_id", "value", "category", "pos", "key")


def _flat_blocks(spark, d):
    return seg.build_blocks(seg.clean_segments(v.segments(spark, d)), paragraphize=False)


def _report_recordings(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("rec_id"),
        F.concat(F.lit(" Rec  "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("https://host.example/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("author"),
        F.lit("00:10").alias("duration_text"),
        F.col("lang").alias("language"),
        F.lit("model a").alias("model"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("created_at"),
        F.lit("Link").alias("source_label"),
    )


def write_transcripts(spark, d):
    cleaned = seg.clean_segments(v.segments(spark, d))
    units = out.transcript_units(cleaned, _flat_blocks(spark, d), _report_recordings(spark, d))
    place = new_place(spark)
    out.write_transcripts(units, place)
    return out.read_transcripts(spark, place).select("rec_id", "format", _long("part"), "content")


def transcript_paragraphs_text(spark, d):
    """Paragraph blocks as units of the text format."""
    blocks = seg.build_blocks(seg.clean_segments(v.segments(spark, d)))
    return out.text_units(blocks).select("rec_id", "unit", "text")


def assign_output_names(spark, d):
    pages = v.table(spark, d, "pages")
    named = pages.select(
        F.lit("out").alias("directory"),
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1).alias("name"),
        F.lit(".md").alias("ext"),
        F.col("page_id").alias("ord"),
    )
    return cat.assign_output_names(named).select("page_id", "file_name")


def evaluation_report(spark, d):
    """The report rows as the sink has written them."""
    place = new_place(spark)
    out.write_report(word_error_rate(spark, d).select("rec_id", "reference_words", "hypothesis_words"), place)
    return out.read_report(spark, place).select(F.get_json_object("report", "$.rec_id").alias("rec_id"), "report")


def read_request_events(spark, d):
    from segmill.sources.events import usable_traffic

    return usable_traffic(v.request_events(spark, d)).select("tab_id", "seq", "request_id", "url", "content_type")


# --- projections and filters ------------------------------------------------------------


def clean_segments(spark, d):
    raw = v.segments(spark, d)
    # Times pulled below 0, inverted ends, noise-only texts and wide spaces.
    messy = raw.withColumns(
        {
            "text": F.when(F.col("seg_idx") % 10 == 3, " .. ").when(F.col("seg_idx") % 10 == 4, F.concat(F.lit("\t"), "text", F.lit("  \n x")))
            .otherwise(F.col("text")),
            "start_ms": F.col("start_ms") - 5000,
            "end_ms": F.when(F.col("seg_idx") % 7 == 2, F.col("start_ms") - 9000).otherwise(F.col("end_ms") - 5000),
        }
    )
    return seg.clean_segments(messy).select("rec_id", _long("seg_idx"), "start_ms", "end_ms", "text", "speaker")


def clip_time_range(spark, d):
    return seg.clip_time_range(v.segments(spark, d), 30_000, 90_000).select("rec_id", _long("seg_idx"), "start_ms", "end_ms")


def _ranges(spark, d):
    docs = v.table(spark, d, "documents")
    i = F.col("doc_id")
    return docs.select(
        i.cast("string").alias("rec_id"),
        F.when(i % 5 != 0, (i % 11) * 1000 - 1000).cast("bigint").alias("range_start_ms"),
        F.when(i % 6 != 0, (i % 11) * 1000 + (i % 13) * 300).cast("bigint").alias("range_end_ms"),
        F.when(i % 7 != 0, F.col("n_chars") * 3).cast("bigint").alias("duration_ms"),
    )


def clip_to_ranges(spark, d):
    valid = seg.validate_ranges(_ranges(spark, d)).filter("valid")
    return seg.clip_to_ranges(v.segments(spark, d), valid).select("rec_id", _long("seg_idx"), "start_ms", "end_ms")


def validate_ranges(spark, d):
    return seg.validate_ranges(_ranges(spark, d)).select("rec_id", "range_start_ms", "range_end_ms", "valid", "reason")


def shift_time(spark, d):
    return seg.shift_time(v.segments(spark, d), -20_000).select("rec_id", _long("seg_idx"), "start_ms", "end_ms")


def attribute_source(spark, d):
    pages = v.table(spark, d, "pages").select("page_id", "url")
    domains = {"example.com": "Com", "m.example.com": "Mobile", "blog.example.org": "Blog", "example.net": "Net"}
    return cat.attribute_source(pages, domains).select("page_id", "source_name", "supported")


def canonicalize_url(spark, d):
    rules = [("example.com", r"(?i)/media\.m3u8$", "/master.m3u8"), ("example.net", r"^/en/", "/eng/")]
    return cat.canonicalize_url(v.media_list(spark, d).select("list_id", "pos", "url"), rules).select(
        "list_id", "pos", "canonical_url"
    )


def classify_media(spark, d):
    return req.classify_media(v.request_events(spark, d)).select("seq", "kind", _long("priority"))


def scrub_headers(spark, d):
    rows = req.scrub_headers(v.request_events(spark, d))
    return rows.select(
        "seq",
        F.col("headers")["User-Agent"].alias("user_agent"),
        F.try_element_at("headers", F.lit("Cookie")).alias("cookie"),
        F.try_element_at("headers", F.lit("Origin")).alias("origin"),
        F.try_element_at("headers", F.lit("Referer")).alias("referer"),
        F.size("headers").cast("bigint").alias("n_headers"),
    )


def guard_public_url(spark, d):
    pages = v.table(spark, d, "pages")
    i = F.col("page_id")
    host = (
        F.when(i % 9 == 0, F.concat(F.lit("10.0.0."), (i % 250).cast("string")))
        .when(i % 9 == 1, F.concat(F.lit("8.8.8."), (i % 250).cast("string")))
        .when(i % 9 == 2, "user:pw@media.example")
        .when(i % 9 == 3, "LocalHost")
        .when(i % 9 == 4, F.concat(F.lit("172."), (i % 40).cast("string"), F.lit(".1.1:8080")))
        .when(i % 9 == 5, "[::1]")
        .when(i % 9 == 6, "printer.local.")
    )
    made = F.when(host.isNotNull(), F.concat(F.lit("https://"), host, F.lit("/x"))).when(i % 9 == 7, "ftp://h/x").otherwise(F.col("url"))
    return cat.guard_public_url(pages.select("page_id", made.alias("url"))).select("page_id", "public", "reason")


def classify_errors(spark, d):
    events = v.table(spark, d, "events")
    kind = F.col("event_type")
    message = (
        F.when(kind == "view", "ERROR: Private video")
        .when(kind == "click", "Connection TIMED OUT")
        .when(kind == "purchase", "HTTP Error 403: Forbidden by FFmpeg")
        .when(kind == "signup", "No space left on device")
        .otherwise(F.col("props"))
    )
    logs = events.select("event_id", message.alias("message"))
    parts = None
    for context in cat.ERROR_RULES:
        part = cat.classify_errors(logs, context).groupBy(F.lit(context).alias("context"), "category").agg(
            F.count(F.lit(1)).alias("n")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _revision_pairs(spark, d):
    segs = v.segments(spark, d)
    i = F.col("seg_idx")
    words = F.split("text", " ")
    revised = (
        F.when(i % 4 == 0, F.concat(F.lit("github "), "text"))
        .when(i % 4 == 1, F.array_join(F.slice(words, 1, 3), " "))
        .when(i % 4 == 2, F.regexp_replace("text", "(?i)the|und|que", "x"))
        .otherwise(F.concat("text", F.lit(" 7")))
    )
    return segs.select(
        "rec_id",
        "seg_idx",
        F.col("text").alias("original"),
        revised.alias("revised"),
        F.array(F.lit("GitHub"), F.lit("la")).alias("glossary"),
        F.when(i % 9 == 0, -1.5).when(i % 9 != 1, -0.2).alias("avg_logprob"),
    )


def accept_revision(spark, d):
    return rev.accept_revision(_revision_pairs(spark, d), TEST_RULES).select("rec_id", _long("seg_idx"), "accepted")


def prefer_complete(spark, d):
    ranked = req.stream_candidates(v.request_events(spark, d).withColumn("headers", req.scrubbed_headers(F.col("headers"))))
    return req.prefer_complete(ranked).select("tab_id", "url", "complete")


# --- joins --------------------------------------------------------------------------------


def _unlabelled(spark, d):
    return v.segments(spark, d).drop("speaker")


def assign_speakers(spark, d):
    return spk.assign_speakers(v.segments(spark, d), v.turns(spark, d)).select(
        "rec_id", _long("seg_idx"), _long("speaker")
    )


def assign_speakers_overlap(spark, d):
    return spk.assign_speakers(v.segments(spark, d), v.turns(spark, d), nearest=False).select(
        "rec_id", _long("seg_idx"), _long("speaker")
    )


def assign_nearest_turn(spark, d):
    return spk.assign_nearest_turn(v.segments(spark, d), v.turns(spark, d)).select(
        "rec_id", _long("seg_idx"), _long("speaker"), _long("gap_ms")
    )


def collapse_tiny_speakers(spark, d):
    return spk.collapse_tiny_speakers(v.turns(spark, d)).select("rec_id", "start_ms", "end_ms", _long("speaker"))


def _doc_texts(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rec_id"), "text")


def match_terms(spark, d):
    hits = glo.match_terms(glo.text_keys(_doc_texts(spark, d)), _dictionary(spark, d))
    return hits.select("rec_id", "term_id", _long("hits"))


def expand_category_defaults(spark, d):
    rows = glo.expand_category_defaults(glo.text_keys(_doc_texts(spark, d)), _dictionary(spark, d))
    return rows.select("rec_id", "category", _long("score"), "term_id", "value")


def merge_revisions(spark, d):
    judged = rev.accept_revision(_revision_pairs(spark, d), TEST_RULES)
    return rev.merge_revisions(v.segments(spark, d), judged).select(
        "rec_id", _long("seg_idx"), "start_ms", "end_ms", "text", "revised"
    )


def _engine_texts(spark, d):
    docs = v.pairs(spark, d)
    return docs.select("rec_id", F.col("reference").alias("text")), docs.select("rec_id", F.col("hypothesis").alias("text"))


def pair_texts(spark, d):
    reference, hypothesis = _engine_texts(spark, d)
    return ev.pair_texts(reference, hypothesis, strict=True).select("rec_id", "reference", "hypothesis", "differs")


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select(
        "seq", "tab_id", "url", F.try_element_at("request_headers", F.lit("User-Agent")).alias("user_agent")
    )


def join_request_response(spark, d):
    return _joined(req.join_request_response(*v.traffic(spark, d)))


# --- aggregations ---------------------------------------------------------------------------


def confidence_summary(spark, d):
    rows = rev.confidence_summary(v.asr(spark, d))
    return rows.select(
        "rec_id", _long("seg_idx"), F.round("avg_logprob", 6).alias("avg_logprob"), "min_logprob", _long("token_count")
    )


def speaker_stats(spark, d):
    return spk.speaker_stats(v.turns(spark, d)).select(
        "rec_id", _long("speaker"), "speech_ms", "turns", "rec_speakers", "rec_turns"
    )


def select_video_renditions(spark, d):
    return cat.select_video_renditions(v.formats(spark, d)).select(
        "rec_id", _long("height"), "label", "container", "approximate_size"
    )


def select_audio_options(spark, d):
    return cat.select_audio_options(v.formats(spark, d)).select(
        "rec_id", "container", "codec", _long("bitrate_kbps"), "approximate_size"
    )


def default_quality(spark, d):
    return cat.default_quality(cat.select_video_renditions(v.formats(spark, d))).select(
        "rec_id", _long("default_quality")
    )


def _doc_recordings(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("rec_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("author"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("tags"),
        F.array("lang").alias("categories"),
    )


def _glossaries(spark, d):
    terms = glo.extract_latin_terms(_doc_recordings(spark, d))
    # At most 64 terms of a recording by definition.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return terms.groupBy("rec_id").agg(F.transform(ordered, lambda t: t["value"]).alias("glossary"))


def segment_features(spark, d):
    rows = rev.segment_features(v.segments(spark, d), _glossaries(spark, d), TEST_RULES)
    return rows.select(
        "rec_id", _long("seg_idx"), _long("glossary_hits"), _long("unknown_latin"), "suspicious_latin",
        "suspicious_term", "pronunciation", "technical_context", "has_numbers", "sparse", _long("compact_chars"),
    )


def word_error_rate(spark, d):
    return ev.word_error_rate(v.pairs(spark, d)).select(
        "rec_id", _long("word_edits"), _long("char_edits"), _long("reference_words"), _long("hypothesis_words"),
        "wer_percent", "cer_percent",
    )


def engine_comparison(spark, d):
    """Three engines per case from the order lines: seconds and error rates by arithmetic."""
    li = v.table(spark, d, "lineitem")
    results = li.groupBy(
        F.col("l_suppkey").alias("case_id"),
        F.when(F.col("l_returnflag") == "A", "fast").when(F.col("l_returnflag") == "R", "mixed").otherwise("full").alias("engine"),
    ).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("seconds"),
        F.max(F.col("l_partkey") % 100).alias("wer_percent"),
        F.max(F.col("l_orderkey") % 100).alias("cer_percent"),
    )
    return ev.engine_comparison(results, ("fast", "mixed", "full"))


def total_speedup(spark, d):
    rows = ev.total_speedup(engine_comparison(spark, d), slow="full", fast="mixed")
    return rows.select("cases", "slow_seconds", "fast_seconds", F.round("speedup", 6).alias("speedup"))


def batch_outcome(spark, d):
    li = v.table(spark, d, "lineitem")
    items = li.select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("item"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("outputs"),
        F.when(F.col("l_returnflag") == "R", "refused").alias("error"),
    )
    return tsk.batch_outcome(items).select("batch_id", "total", "errors", "completed", "status")


def candidate_share(spark, d):
    """Reviewed share of each recording with the sentence-final segments as candidates."""
    segs = v.segments(spark, d)
    picked = segs.filter(F.col("text").endswith("."))
    span = segs.groupBy("rec_id").agg(F.max("end_ms").alias("duration_ms"))
    return ev.candidate_share(picked, span).select("rec_id", "candidates", "reviewed_ms")


# --- windows and top-k ------------------------------------------------------------------------


def dedupe_rolling_captions(spark, d):
    return cap.dedupe_rolling_captions(v.cues(spark, d)).select("rec_id", _long("seg_idx"), "start_ms", "end_ms", "text")


def build_blocks(spark, d):
    blocks = seg.number_blocks(seg.build_blocks(seg.clean_segments(v.segments(spark, d))))
    return blocks.select(
        "rec_id", _long("block_idx"), _long("first_seg"), "start_ms", "end_ms", "text", "speaker", _long("n_segments")
    )


def block_stats(spark, d):
    """Blocks, their length and duration per speaker and language of the document."""
    blocks = seg.build_blocks(seg.clean_segments(v.segments(spark, d)))
    lang = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rec_id"), "lang")
    return blocks.join(lang, "rec_id").groupBy("lang", "speaker").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("n_segments").alias("segments"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
    )


def renumber_speakers(spark, d):
    messy = v.turns(spark, d).withColumns({"start_ms": F.col("start_ms") - 700, "speaker": 5 - F.col("speaker") * 2})
    return spk.renumber_speakers(messy).select("rec_id", "start_ms", "end_ms", _long("speaker"))


def low_confidence_flag(spark, d):
    rows = rev.confidence_summary(v.asr(spark, d))
    return rev.low_confidence_flag(rows).select("rec_id", _long("seg_idx"), "low_confidence")


def _scored(spark, d, glossaries=None):
    rows = rev.confidence_summary(v.asr(spark, d))
    flagged = rev.low_confidence_flag(rows)
    return rev.review_scores(rev.segment_features(flagged, glossaries or _glossaries(spark, d), TEST_RULES))


def review_scores(spark, d):
    return _scored(spark, d).select("rec_id", _long("seg_idx"), _long("score"), F.array_join("reasons", ",").alias("reasons"))


def select_review_candidates(spark, d):
    return rev.select_review_candidates(_scored(spark, d)).select("rec_id", _long("seg_idx"), _long("score"))


def choose_subtitle_track(spark, d):
    return cap.choose_subtitle_track(meta.tracks(_parsed(spark, d))).select(
        "rec_id", "language", "kind", "file_format", "name"
    )


def choose_subtitle_track_requested(spark, d):
    return cap.choose_subtitle_track(meta.tracks(_parsed(spark, d)), language="en").select(
        "rec_id", "language", "kind", "file_format", "name"
    )


def list_subtitle_options(spark, d):
    return cap.list_subtitle_options(meta.tracks(_parsed(spark, d))).select(
        "rec_id", _long("option"), "language", "name", "automatic"
    )


def dedupe_media_list(spark, d):
    return cat.dedupe_media_list(v.media_list(spark, d)).select(
        "list_id", _long("index"), "pos", "url", "title", "duration_s", "duration_text", "truncated"
    )


def progress_and_eta(spark, d):
    events = v.table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), "event_id", F.col("event_type").alias("stage"),
        F.unix_millis("ts").alias("ts_ms"), F.col("value").alias("done"), F.lit(40.0).alias("total"),
    )
    return tsk.progress_and_eta(events).select(
        "event_id", F.round("percent", 4).alias("percent"), F.round("eta_seconds", 3).alias("eta_seconds")
    )


def rank_stream_candidates(spark, d):
    events = v.request_events(spark, d).withColumn("headers", req.scrubbed_headers(F.col("headers")))
    ranked = req.rank_stream_candidates(req.stream_candidates(events))
    return ranked.select(
        "tab_id", _long("rank"), "url", "seq", _long("priority"), F.try_element_at("headers", F.lit("User-Agent")).alias("user_agent")
    )


# --- set-like ---------------------------------------------------------------------------------


def extract_metadata_terms(spark, d):
    return glo.extract_metadata_terms(_doc_recordings(spark, d)).select("rec_id", _long("pos"), "value")


def extract_latin_terms(spark, d):
    return glo.extract_latin_terms(_doc_recordings(spark, d)).select("rec_id", _long("pos"), "value")


def _custom(spark, d):
    return glo.clean_custom_terms(glo.split_custom_terms(_doc_texts(spark, d), "text"))


def clean_custom_terms(spark, d):
    return _custom(spark, d).select("rec_id", _long("pos"), "value")


def build_glossary(spark, d):
    rows = glo.build_glossary(_doc_recordings(spark, d), _doc_texts(spark, d), _custom(spark, d), _dictionary(spark, d))
    return rows.select("rec_id", _long("pos"), "value", "source", "category", _long("score"))


def merged_glossary(spark, d):
    custom = _custom(spark, d)
    return glo.merged_glossary(custom, _doc_recordings(spark, d)).select("rec_id", _long("pos"), "value")


# --- state, in batch and as streams --------------------------------------------------------------

TASK_COLUMNS = ("task_id", "status", "stage", "progress", "downloaded_bytes", "last_seq")


def task_state(spark, d):
    return tsk.task_state(v.task_events(spark, d)).select(*TASK_COLUMNS)


def job_state(spark, d):
    return tsk.job_state(v.job_events(spark, d)).select(
        "owner", "job_id", _long("rank"), "created_at", "status", "stage", "progress", "task_id"
    )


def submit_once(spark, d):
    return tsk.submit_once(v.submissions(spark, d)).select("seq", "client_request_id", "task_id", "effective_task_id")


def stream_candidates_stream(spark, d):
    rows = runs.candidate_run(spark, d)
    return rows.filter("rank > 0").select("tab_id", _long("rank"), "url", _long("priority"))


def task_state_stream(spark, d):
    return runs.task_run(spark, d).select(*TASK_COLUMNS[:-1])


def task_state_late_stream(spark, d):
    return runs.late_task_run(spark, d)[0].select(*TASK_COLUMNS[:-1])


def late_task_events(spark, d):
    return runs.late_task_run(spark, d)[1]


def job_state_stream(spark, d):
    return runs.job_run(spark, d).select(
        "owner", "job_id", _long("rank"), "created_at", "status", "stage", "progress", "task_id"
    )


def join_request_response_stream(spark, d):
    return _joined(runs.join_run(spark, d))


def submit_once_stream(spark, d):
    return runs.submit_run(spark, d).select("seq", "client_request_id", "task_id", "effective_task_id")


def align_revision_boundaries(spark, d):
    pairs = _revision_pairs(spark, d).select("rec_id", "seg_idx", "original", "revised")
    return ali.align_revision_boundaries(pairs).select("rec_id", _long("seg_idx"), "aligned")


# --- revision, search, source choice ---------------------------------------------------------------


def revise_transcripts(spark, d):
    segments, glossaries = v.segments(spark, d), checkpointed(_glossaries(spark, d))  # read twice below
    candidates = rev.select_review_candidates(_scored(spark, d, glossaries))
    second = _revision_pairs(spark, d).select("rec_id", "seg_idx", F.col("revised").alias("text"), "avg_logprob")
    return rev.revise_transcripts(segments, candidates, second, glossaries, TEST_RULES).select(
        "rec_id", _long("seg_idx"), "text", "revised"
    )


def search_transcripts(spark, d):
    return cat.search_transcripts(_doc_texts(spark, d), "The").select("rec_id", _long("line"), "text", _long("hits"))


def search_top_documents(spark, d):
    hits = cat.search_transcripts(_doc_texts(spark, d), "The")
    return cat.top_documents(hits, 20).select("rec_id", _long("hits"), "lines")


def find_next(spark, d):
    return cat.find_next(_doc_texts(spark, d), "Der", 500).select("rec_id", _long("position"), _long("line"))


def _captions(spark, d):
    """Captions of the recordings that are not German; the others have none."""
    captioned = v.table(spark, d, "documents").filter("lang <> 'de'").select(F.col("doc_id").cast("string").alias("rec_id"))
    return v.cues(spark, d).withColumnRenamed("cue_idx", "seg_idx").join(captioned, "rec_id", "left_semi")


def reconcile_text_source(spark, d):
    recordings = _doc_texts(spark, d).select("rec_id")
    chosen, _ = cap.reconcile_text_source(recordings, _captions(spark, d), v.segments(spark, d))
    return chosen.select("rec_id", _long("seg_idx"), "start_ms", "end_ms", "text", "source")


def reconcile_status(spark, d):
    recordings = _doc_texts(spark, d).select("rec_id")
    _, status = cap.reconcile_text_source(recordings, _captions(spark, d), v.segments(spark, d), source="subtitles")
    return status.select("rec_id", "source", "segments", "error")


def transcripts_end_to_end(spark, d):
    """Captions to paragraphs: de-rolled, clipped, labelled with speakers, cleaned, grouped, written as units."""
    from segmill.plans.transcripts import caption_transcripts

    blocks = caption_transcripts(v.caption_files(spark, d), v.turns(spark, d))
    return blocks.select("rec_id", _long("first_seg"), "start_ms", "end_ms", "text", "speaker", _long("n_segments"))


QUERIES: dict[str, Query] = {
    name: made
    for name, made in globals().items()
    if callable(made) and getattr(made, "__module__", "") == __name__ and not name.startswith("_")
}
