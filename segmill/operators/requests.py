"""Web-request events in batch form: headers, media kinds, joins, ranking of stream candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions import urls

# Media patterns, priorities, header names and limits.
MEDIA_URL = r"(?i)\.(?:m3u8|mpd|mp4|webm|m4v|mov|m4a|aac)(?:$|[?#])"
VIDEO_URL = r"(?i)\.(?:mp4|webm|m4v|mov)(?:$|[?#])"
MEDIA_CONTENT_TYPES = (
    "application/vnd.apple.mpegurl",
    "application/x-mpegurl",
    "application/dash+xml",
    "video/",
    "audio/mp4",
    "audio/aac",
)
COMPLETE_PATHS = ("/master.m3u8", "/master.mpd", "/manifest.mpd")
ALLOWED_HEADERS = {
    "authorization": "Authorization",
    "cookie": "Cookie",
    "origin": "Origin",
    "referer": "Referer",
    "user-agent": "User-Agent",
}
MAX_HEADER = 16_384
MAX_HEADERS = 32_768
MAX_CANDIDATES = 24


def content_type_of(headers: Column) -> Column:
    """The bare, folded content type of a response header list."""
    named = F.filter(headers, lambda h: F.lower(h["name"]) == "content-type")
    value = F.coalesce(F.get(named, F.lit(0))["value"], F.lit(""))
    return F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))


def is_media_type(content_type: Column) -> Column:
    hit = F.lit(False)
    for prefix in MEDIA_CONTENT_TYPES:
        hit = hit | content_type.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def media_kind(url: Column, content_type: Column) -> Column:
    both = F.lower(F.concat_ws(" ", url, F.coalesce(content_type, F.lit(""))))
    has = lambda needle: F.contains(both, F.lit(needle))
    return (
        F.when(has(".m3u8") | has("mpegurl"), "hls")
        .when(has(".mpd") | has("dash+xml"), "dash")
        .when(has("audio/"), "audio")
        .when(url.rlike(VIDEO_URL) | has("video/"), "video")
        .otherwise("unknown")
    )


def media_priority(url: Column) -> Column:
    """Rank by path: full playlists before part lists before plain files."""
    path = F.lower(urls.path(url))
    return (
        F.when(path.endswith("/master.m3u8") | path.endswith("/master.mpd"), 1000)
        .when(path.endswith("/manifest.mpd"), 900)
        .when(path.endswith(".m3u8"), 500)
        .when(path.endswith(".mpd"), 450)
        .when(path.rlike(r"\.(?:mp4|webm|m4v|mov)$"), 200)
        .when(path.rlike(r"\.(?:m4a|aac)$"), 100)
        .otherwise(0)
    )


def is_complete(url: Column) -> Column:
    path = F.lower(urls.path(url))
    hit = F.lit(False)
    for ending in COMPLETE_PATHS:
        hit = hit | path.endswith(ending)
    return hit


def classify_media(df: DataFrame) -> DataFrame:
    """Add ``kind`` and ``priority`` to rows with ``url, content_type``."""
    return df.withColumns(
        {"kind": media_kind(F.col("url"), F.col("content_type")), "priority": media_priority(F.col("url"))}
    )


def scrubbed_headers(headers: Column, on_oversize: str = "skip") -> Column:
    """Allowed headers as a map with canonical names; a later spelling of a name wins.

    ``skip`` leaves out what is too long; ``reject`` makes the whole map null.
    """
    names = F.create_map(*[F.lit(x) for pair in ALLOWED_HEADERS.items() for x in pair])
    named = F.transform(
        headers,
        lambda h: F.struct(
            F.try_element_at(names, F.lower(F.trim(h["name"]))).alias("name"),
            F.coalesce(h["value"], F.lit("")).alias("value"),
        ),
    )
    allowed = F.filter(named, lambda h: h["name"].isNotNull() & (h["value"] != "") & ~h["value"].rlike(r"[\r\n]"))
    start = F.struct(F.lit(0).alias("total"), F.create_map().cast("map<string,string>").alias("kept"))
    if on_oversize == "skip":
        short = F.filter(allowed, lambda h: F.length(h["value"]) <= MAX_HEADER)
        return F.aggregate(
            short,
            start,
            lambda acc, h: F.when(
                acc["total"] + F.length(h["value"]) <= MAX_HEADERS,
                F.struct((acc["total"] + F.length(h["value"])).alias("total"), _put(acc["kept"], h).alias("kept")),
            ).otherwise(acc),
            lambda acc: acc["kept"],
        )
    if on_oversize != "reject":
        raise ValueError("on_oversize must be skip or reject")
    total = F.aggregate(allowed, F.lit(0), lambda acc, h: acc + F.length(h["value"]))
    too_long = F.exists(allowed, lambda h: F.length(h["value"]) > MAX_HEADER) | (total > MAX_HEADERS)
    kept = F.aggregate(allowed, start["kept"], _put)
    return F.when(~too_long, kept)


def _put(kept: Column, header: Column) -> Column:
    others = F.map_filter(kept, lambda name, _: name != header["name"])
    return F.map_concat(others, F.create_map(header["name"], header["value"]))


def scrub_headers(df: DataFrame, on_oversize: str = "skip", add_referer: bool = True) -> DataFrame:
    """Replace the header list of ``df(headers, page_url)`` by the map of allowed headers."""
    kept = scrubbed_headers(F.col("headers"), on_oversize)
    if add_referer:
        missing = (F.coalesce("page_url", F.lit("")) != "") & ~F.map_contains_key("headers", "Referer")
        with_page = F.map_concat("headers", F.create_map(F.lit("Referer"), F.col("page_url")))
        return df.withColumn("headers", kept).withColumn(
            "headers", F.when(missing, with_page).otherwise(F.col("headers"))
        )
    return df.withColumn("headers", kept)


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Request and response rows of http(s) traffic that belongs to a tab."""
    usable = events.filter((F.col("tab_id") >= 0) & urls.is_http(F.col("url")))
    return usable.filter("event = 'request'"), usable.filter("event = 'response'")


def join_request_response(
    requests: DataFrame, responses: DataFrame, within: str = "10 minutes", completions: DataFrame | None = None
) -> DataFrame:
    """Give media responses the headers of their last request, if it was seen shortly before.

    A request id may come several times, by redirects; of requests at one time the one
    whose headers are last as JSON text counts. ``completions`` (``request_id, ts``) end a
    request: a later response does not find it any more.
    """
    known = requests.filter(F.col("request_id").isNotNull()).groupBy("request_id", "ts")
    turns = known.agg(F.max_by("headers", F.coalesce(F.to_json("headers"), F.lit(""))).alias("request_headers"))
    media = responses.filter(is_media_type(F.col("content_type")))
    if completions is not None:
        ends = completions.filter(F.col("request_id").isNotNull()).select("request_id", "ts", F.lit(True).alias("done"))
        turns = turns.withColumn("done", F.lit(False)).unionByName(ends.distinct(), allowMissingColumns=True)
    else:
        turns = turns.withColumn("done", F.lit(False))
    order = Window.partitionBy("request_id").orderBy("ts", "done")
    turns = turns.withColumns({"next_ts": F.lead("ts").over(order), "next_done": F.lead("done").over(order)}).filter(~F.col("done"))
    turns = turns.select(F.col("request_id").alias("req_id"), F.col("ts").alias("req_ts"), "request_headers", "next_ts", "next_done")
    # A response at the time of the next request belongs to that one, one at the time of the completion to this one.
    before_next = F.col("next_ts").isNull() | (F.col("ts") < F.col("next_ts")) | (F.col("next_done") & (F.col("ts") == F.col("next_ts")))
    recent = (
        (F.col("request_id") == F.col("req_id"))
        & (F.col("ts") >= F.col("req_ts"))
        & (F.col("ts") <= F.col("req_ts") + F.expr(f"interval {within}"))
        & before_next
    )
    return media.join(turns, recent, "left").drop("req_id", "req_ts", "next_ts", "next_done")


def stream_candidates(events: DataFrame) -> DataFrame:
    """The candidates alive per tab after the last page change.

    ``events`` has ``tab_id, seq, kind, url, headers map, ts`` with kind ``candidate`` or
    ``reset``. Per URL the latest sighting counts, with the latest non-empty headers.
    """
    resets = events.filter("kind = 'reset'").groupBy("tab_id").agg(F.max("seq").alias("reset_seq"))
    alive = (
        events.filter("kind = 'candidate'")
        .join(resets, "tab_id", "left")
        .filter(F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq")))
    )
    filled = F.coalesce(F.size("headers") > 0, F.lit(False))
    return alive.groupBy("tab_id", "url").agg(
        F.max("seq").alias("seq"),
        F.max_by("ts", "seq").alias("detected_at"),
        F.max_by("content_type", "seq").alias("content_type"),
        F.max_by(F.when(filled, F.col("headers")), F.when(filled, F.col("seq"))).alias("headers"),
    ).withColumn("priority", media_priority(F.col("url")))


def rank_stream_candidates(candidates: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """The best ``k`` candidates of each tab by priority, then by time."""
    order = Window.partitionBy("tab_id").orderBy(F.desc("priority"), F.desc("detected_at"), F.desc("seq"))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prefer_complete(candidates: DataFrame) -> DataFrame:
    """Per tab only complete playlists if there is one, else everything."""
    flagged = candidates.withColumn("complete", is_complete(F.col("url")))
    tabs = flagged.groupBy("tab_id").agg(F.max("complete").alias("any_complete"))
    return flagged.join(tabs, "tab_id").filter(F.col("complete") | ~F.col("any_complete")).drop("any_complete")
