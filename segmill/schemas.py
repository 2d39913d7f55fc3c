"""Table schemas shared by sources, operators and streams."""

from __future__ import annotations

SEGMENTS = "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string"
CUES = "rec_id string, cue_idx int, start_ms bigint, end_ms bigint, text string"
TURNS = "rec_id string, start_ms bigint, end_ms bigint, speaker int"
FORMATS = (
    "rec_id string, ord int, height double, ext string, vcodec string, acodec string, "
    "tbr double, abr double, filesize double, filesize_approx double"
)
TRACKS = (
    "map<string, array<struct<ext: string, url: string, name: string>>>"
)

# Extractor metadata JSON: only the fields the operators read.
MEDIA_METADATA = (
    "title string, channel string, uploader string, duration double, thumbnail string, "
    "description string, tags array<string>, categories array<string>, id string, "
    "extractor_key string, webpage_url string, "
    "formats array<struct<height: double, ext: string, vcodec: string, acodec: string, "
    "tbr: double, abr: double, filesize: double, filesize_approx: double>>, "
    f"subtitles {TRACKS}, automatic_captions {TRACKS}"
)

REQUEST_EVENTS = (
    "tab_id bigint, request_id string, event string, url string, page_url string, ts timestamp, "
    "headers array<struct<name: string, value: string>>, content_type string"
)

# The six counters a stage change resets.
TASK_COUNTERS = (
    "processed_seconds",
    "total_seconds",
    "eta_seconds",
    "downloaded_bytes",
    "total_bytes",
    "speed_bytes_per_second",
)
TASK_EVENTS = (
    "task_id string, seq bigint, kind string, stage string, progress double, details map<string, double>"
)
