"""Media catalogues: renditions, sources, URL identity and safety, media lists, file names, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions import urls
from segmill.functions.arrays import let
from segmill.functions.text import WHITESPACE, collapse_spaces
from segmill.functions.times import duration_text
from segmill.operators.ordered import CHUNK_ROWS, Running, position_chunk, with_running

# Known media sites, list limits, file-name rules.
MEDIA_DOMAINS = {
    "youtube.com": "YouTube",
    "youtu.be": "YouTube",
    "rutube.ru": "Rutube",
    "vk.com": "VK Video",
    "vkvideo.ru": "VK Video",
    "vimeo.com": "Vimeo",
    "dailymotion.com": "Dailymotion",
    "dai.ly": "Dailymotion",
    "tiktok.com": "TikTok",
    "twitch.tv": "Twitch",
    "soundcloud.com": "SoundCloud",
}
OTHER_SOURCE = "Медиа"
PREFERRED_HEIGHT = 1080
MAX_LIST_ITEMS = 50
UNTITLED_ITEM = "Видео "
MAX_NAME_LENGTH = 180
FORBIDDEN_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10)))
UNKNOWN_CONTAINER = "неизвестно"


# --- renditions ---------------------------------------------------------------------


def _absent(codec: Column) -> Column:
    return codec.isNull() | (codec == "none")


def approximate_size(exact: Column, estimate: Column) -> Column:
    """The exact size, or the estimate where the exact one is null or 0; null unless positive."""
    size = F.when(exact.isNotNull() & (exact != 0), exact).otherwise(estimate)
    return F.when(size > 0, size.cast("bigint"))


def select_video_renditions(formats: DataFrame) -> DataFrame:
    """The best format per recording and frame height; equal scores keep the first listed."""
    size = approximate_size(F.col("filesize"), F.col("filesize_approx"))
    height = F.col("height").cast("int")
    usable = formats.filter(~_absent(F.col("vcodec")) & (F.col("height") > 0)).withColumns(
        {"height": height, "size": size}
    )
    score = F.struct(
        F.coalesce(F.col("ext") == "mp4", F.lit(False)).alias("mp4"),
        (~_absent(F.col("acodec"))).alias("audio"),
        F.col("size").isNotNull().alias("sized"),
        F.coalesce(F.col("tbr").cast("double"), F.lit(0.0)).alias("tbr"),
        (-F.col("ord")).alias("early"),
    )
    kept = F.struct("ext", "size")
    return (
        usable.groupBy("rec_id", "height")
        .agg(F.max_by(kept, score).alias("best"))
        .select(
            "rec_id",
            "height",
            F.concat("height", F.lit("p")).alias("label"),
            F.upper(F.when(F.col("best.ext") != "", F.col("best.ext")).otherwise(UNKNOWN_CONTAINER)).alias("container"),
            F.col("best.size").alias("approximate_size"),
        )
    )


def select_audio_options(formats: DataFrame) -> DataFrame:
    """The best audio-only format per recording and container; equal bit rates keep the first listed."""
    usable = formats.filter(~_absent(F.col("acodec")) & _absent(F.col("vcodec")))
    container = F.lower(F.when(F.col("ext") != "", F.col("ext")).otherwise("unknown"))
    score = F.struct(F.coalesce(F.col("abr").cast("double"), F.lit(0.0)).alias("abr"), (-F.col("ord")).alias("early"))
    kept = F.struct(
        "acodec", "abr", approximate_size(F.col("filesize"), F.col("filesize_approx")).alias("size")
    )
    return (
        usable.groupBy("rec_id", container.alias("code"))
        .agg(F.max_by(kept, score).alias("best"))
        .select(
            "rec_id",
            F.upper("code").alias("container"),
            F.col("best.acodec").alias("codec"),
            F.bround("best.abr").cast("int").alias("bitrate_kbps"),
            F.col("best.size").alias("approximate_size"),
        )
    )


def default_quality(renditions: DataFrame) -> DataFrame:
    """The tallest rendition up to 1080, else the smallest one."""
    fitting = F.max(F.when(F.col("height") <= PREFERRED_HEIGHT, F.col("height")))
    return renditions.groupBy("rec_id").agg(F.coalesce(fitting, F.min("height")).alias("default_quality"))


# --- URLs ---------------------------------------------------------------------------


def attribute_source(df: DataFrame, domains: dict[str, str] | None = None, url: str = "url") -> DataFrame:
    """Add ``source_name`` and ``supported`` by the longest known suffix of the host."""
    known = MEDIA_DOMAINS if domains is None else domains
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    suffixes = let(
        F.split(urls.host(F.col(url)), r"\."),
        lambda labels: F.transform(
            F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        ),
    )
    names = F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda n: n.isNotNull())
    name = F.get(names, F.lit(0))
    return df.withColumns(
        {
            "source_name": F.coalesce(name, F.lit(OTHER_SOURCE)),
            "supported": F.col(url).isNotNull() & urls.is_http(F.col(url)) & name.isNotNull(),
        }
    )


def canonicalize_url(
    df: DataFrame, rules: Sequence[tuple[str, str, str]] = (), url: str = "url", out: str = "canonical_url"
) -> DataFrame:
    """Add the URL's identity; ``rules`` are ``(domain, path pattern, replacement)`` rewrites.

    A rewrite applies to hosts at or below its domain and to the path only.
    """
    value = F.trim(F.col(url))
    host, path = urls.host(value), urls.path(value)
    new_path = path
    for domain, pattern, replacement in rules:
        new_path = F.when(
            urls.host_matches(host, domain), F.regexp_replace(new_path, pattern, replacement)
        ).otherwise(new_path)
    if rules:
        head = F.regexp_extract(value, r"^([^/?#]*//[^/?#]*)", 1)
        tail = F.regexp_extract(value, r"^[^/?#]*//[^/?#]*[^?#]*(.*)$", 1)
        value = F.concat(head, new_path, tail)
    return df.withColumn(out, urls.canonical(value))


def guard_public_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``public`` and the ``reason`` a URL is refused: scheme, credentials, local name, private address."""
    value = F.col(url)
    host = urls.host(value)
    octets = F.transform(F.split(host, r"\."), lambda part: part.try_cast("int"))
    a, b, c = octets[0], octets[1], octets[2]
    is_v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    # Ranges that are not globally reachable.
    private_v4 = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | F.exists(octets, lambda part: part > 255)
    )
    groups = urls.ipv6_groups(host)
    first, second = groups[0], groups[1]
    # Unspecified, loopback and embedded IPv4; unique local, link-local, multicast, documentation.
    private_v6 = host.startswith("[") & F.coalesce(
        (F.forall(F.slice(groups, 1, 5), lambda x: x == 0) & groups[5].isin(0, 0xFFFF))
        | first.between(0xFC00, 0xFDFF)
        | first.between(0xFE80, 0xFEBF)
        | (first >= 0xFF00)
        | ((first == 0x2001) & (second == 0xDB8)),
        F.lit(True),
    )
    reason = (
        F.when(~F.coalesce(urls.is_http(value), F.lit(False)), F.lit("scheme"))
        .when(urls.userinfo(value) != "", F.lit("credentials"))
        .when((host == "localhost") | host.endswith(".localhost") | host.endswith(".local"), F.lit("local_name"))
        .when((is_v4 & private_v4) | private_v6, F.lit("private_address"))
    )
    return df.withColumns({"reason": reason, "public": reason.isNull()})


# --- media lists --------------------------------------------------------------------


def dedupe_media_list(entries: DataFrame, cap: int = MAX_LIST_ITEMS, pasted: bool = False) -> DataFrame:
    """Unique items of each list in order, renumbered, at most ``cap``, with a ``truncated`` flag.

    ``entries`` has ``list_id, pos, id, extractor_key, url, title, duration`` and
    optionally ``reported_count``. For ``pasted`` lists the URL is the identity and
    the cap applies before media identity is looked at.
    """
    url = F.trim(F.col("url"))
    safe = entries.withColumn("url", url).filter(urls.is_http(F.col("url")))
    if "reported_count" not in safe.columns:
        safe = safe.withColumn("reported_count", F.lit(None).cast("bigint"))
    media, extractor = F.trim("id"), F.trim("extractor_key")
    by_url = urls.canonical(F.col("url"))
    named = (F.coalesce(media, F.lit("")) != "") & (F.coalesce(extractor, F.lit("")) != "")
    by_id = F.when(named, F.concat_ws(":", F.lower(extractor), media)).otherwise(by_url)
    payload = F.struct("pos", "url", "title", "duration", "reported_count", by_id.alias("media"))

    def first_of(rows: DataFrame, identity: Column) -> DataFrame:
        return rows.groupBy("list_id", identity.alias("identity")).agg(
            F.min_by(payload, F.col("pos")).alias("item")
        )

    order = Window.partitionBy("list_id").orderBy("item.pos")
    # One more than the cap tells whether the list was cut.
    unique = first_of(safe, by_url if pasted else by_id)
    ranked = unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap + 1)
    bounded = Window.partitionBy("list_id")
    ranked = ranked.withColumn("over", F.max("rank").over(bounded) > cap).filter(F.col("rank") <= cap)
    if pasted:
        ranked = ranked.groupBy("list_id", F.col("item.media").alias("identity")).agg(
            F.min_by("item", "rank").alias("item"), F.max("over").alias("over")
        )
    ranked = ranked.withColumn("index", F.row_number().over(order))
    reported = F.coalesce(F.max("item.reported_count").over(bounded) > cap, F.lit(False))
    title = collapse_spaces(F.coalesce("item.title", F.lit("")))
    duration = F.when(F.col("item.duration") >= 0, F.col("item.duration").cast("bigint"))
    return ranked.select(
        "list_id",
        "index",
        F.col("item.pos").alias("pos"),
        F.col("item.url").alias("url"),
        F.when(title != "", title).otherwise(F.concat(F.lit(UNTITLED_ITEM), F.col("index"))).alias("title"),
        duration.alias("duration_s"),
        duration_text(duration).alias("duration_text"),
        (F.col("over") | reported).alias("truncated"),
    )


# --- file names ---------------------------------------------------------------------


def safe_name(name: Column, fallback: str = "video", max_length: int = MAX_NAME_LENGTH) -> Column:
    """A file name any desktop system accepts."""
    clean = F.regexp_replace(name, FORBIDDEN_NAME_CHARS, "_")
    clean = F.regexp_replace(F.regexp_replace(clean, WHITESPACE, " "), r"^[ .]+|[ .]+$", "")
    clean = F.when(clean == "", F.lit(fallback)).otherwise(clean)
    device = F.upper(F.split_part(clean, F.lit("."), F.lit(1))).isin(*RESERVED_NAMES)
    clean = F.when(device, F.concat(F.lit("_"), clean)).otherwise(clean)
    cut = F.regexp_replace(F.substring(clean, 1, max_length), r"[ .]+$", "")
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def assign_output_names(
    df: DataFrame,
    directory: str = "directory",
    name: str = "name",
    ext: str = "ext",
    position: str = "ord",
    existing: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``file_name``: the safe name, with `` (2)``, `` (3)``... for later holders of a taken name.

    ``position`` numbers the requests in order. ``existing(directory, file_name)`` are
    names already on disk. A holder gets the first free number: neither on disk nor the
    literal name of another request, which keeps it wherever it comes in the order. Of
    requests that spell one literal name with different extensions, the first has it.
    """
    key = [directory, "_stem", ext]
    stemmed = df.withColumn("_stem", safe_name(F.col(name)))
    place = position_chunk(position, chunk_rows)
    ranked = with_running(stemmed, key, [position], place, {"_rank": Running("sum", F.lit(1))})

    literal = F.concat("_stem", ext).alias("_file")
    stems = stemmed.groupBy(*key).agg(F.min(position).alias("_first"))
    spelled = Window.partitionBy(directory, "_file")
    stems = stems.select(*key, "_first", literal).withColumn("_owner", F.min(F.struct("_first", ext)).over(spelled))
    held = _numbered_names(stems.select(directory, "_file"), directory, ext).unionByName(
        stems.filter(F.struct("_first", ext) != F.col("_owner")).select(*key, F.lit(1).cast("bigint").alias("_held"))
    )
    if existing is not None:
        files = existing.select(F.col("directory").alias(directory), F.col("file_name").alias("_file"))
        held = held.unionByName(_numbered_names(files, directory, ext)).unionByName(
            _splits(files, directory, ext).withColumn("_held", F.lit(1).cast("bigint"))
        )
    held = held.distinct().join(stems.select(*key), key, "left_semi")
    held = with_running(held, key, ["_held"], position_chunk("_held", chunk_rows), {"_i": Running("sum", F.lit(1))})
    # A held number stands behind the request whose rank is the count of free numbers before it.
    held = held.select(*key, (2 * (F.col("_held") - F.col("_i")) + 1).alias("_at"), "_held")
    rows = ranked.withColumns({"_at": 2 * F.col("_rank"), "_held": F.lit(0).cast("bigint")})
    passed = Running("sum", (F.col("_held") > 0).cast("bigint"))
    rows = with_running(
        rows.unionByName(held, allowMissingColumns=True),
        key,
        ["_at", "_held"],
        position_chunk("_at", chunk_rows),
        {"_passed": passed},
    ).filter("_held = 0")
    number = F.col("_rank") + F.col("_passed")
    named = rows.withColumn("file_name", _numbered(F.col("_stem"), number, F.col(ext)))
    return named.select(*df.columns, "file_name")


def _numbered(stem: Column, number: Column, ext: Column) -> Column:
    base = F.when(number > 1, F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(stem)
    return F.concat(base, ext)


def _splits(files: DataFrame, directory: str, ext: str) -> DataFrame:
    """Every way to read a file name as stem and extension: cut at each dot, or without an extension."""
    parts = F.split("_file", r"\.")

    def cut(i: Column) -> Column:
        rest = F.slice(parts, i + 1, F.size(parts))
        tail = F.when(i < F.size(parts), F.concat(F.lit("."), F.array_join(rest, "."))).otherwise(F.lit(""))
        return F.struct(F.array_join(F.slice(parts, F.lit(1), i), ".").alias("_stem"), tail.alias(ext))

    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), cut)
    return files.filter(F.col("_file").isNotNull()).select(directory, F.inline(cuts))


def _numbered_names(files: DataFrame, directory: str, ext: str) -> DataFrame:
    """The numbers that file names hold: ``x (2).md`` holds 2 of ``x``."""
    form = r"(?s)^(.+) \(([1-9][0-9]*)\)$"
    number = F.regexp_extract("_stem", form, 2).try_cast("bigint")
    read = _splits(files, directory, ext).withColumn("_held", number).filter("_held > 1")
    return read.withColumn("_stem", F.regexp_extract("_stem", form, 1))


# --- errors -------------------------------------------------------------------------

# Per context, ordered (category, substrings of the lower-cased message).
ERROR_RULES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "analysis": (
        ("private", ("private video",)),
        ("unavailable", ("video unavailable", "not available")),
        ("age_restricted", ("sign in to confirm your age", "age-restricted")),
    ),
    "video_download": (
        ("ffmpeg", ("ffmpeg",)),
        ("disk_full", ("no space left", "not enough space")),
        ("file_busy", ("unable to rename", "winerror 32")),
        ("connection", ("timed out", "connection")),
    ),
    "audio_download": (
        ("ffmpeg", ("ffmpeg",)),
        ("disk_full", ("no space left", "not enough space")),
        ("connection", ("timed out", "connection")),
        ("no_audio", ("requested format is not available",)),
    ),
    "stream": (
        ("drm", ("drm", "encrypted")),
        ("forbidden", ("403", "forbidden", "401", "unauthorized")),
        ("not_found", ("404", "not found")),
    ),
    "list": (
        ("private", ("private",)),
        ("sign_in", ("sign in", "login", "age-restricted")),
        ("unavailable", ("unavailable", "not available", "removed")),
    ),
    "transcription": (
        ("out_of_memory", ("out of memory", "memory allocation")),
        ("invalid_audio", ("invalid data", "averror")),
    ),
}


def classify_errors(df: DataFrame, context: str, rules: Sequence[tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """Add ``category``: the first rule of the context with a substring in the message, else ``other``."""
    lowered = F.lower("message")
    category = F.lit("other")
    for name, needles in reversed(tuple(rules if rules is not None else ERROR_RULES[context])):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(lowered, F.lit(needle))
        category = F.when(hit, F.lit(name)).otherwise(category)
    return df.withColumn("category", category)


# --- text search --------------------------------------------------------------------


def search_transcripts(docs: DataFrame, query: str) -> DataFrame:
    """Lines of ``docs(rec_id, text)`` that contain ``query`` in any letter case, with their counts."""
    needle = F.lit(query.strip().lower())
    lines = docs.filter(F.contains(F.lower("text"), needle)).select(
        "rec_id", F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    removed = F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), needle, F.lit("")))
    return lines.filter(F.contains(F.lower("text"), needle)).select(
        "rec_id",
        (F.col("line") + 1).alias("line"),
        "text",
        F.floor(removed / F.length(needle)).cast("int").alias("hits"),
    )


def top_documents(hits: DataFrame, k: int = 10) -> DataFrame:
    """Documents with most hits, then by id."""
    totals = hits.groupBy("rec_id").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("lines"))
    return totals.orderBy(F.desc("hits"), "rec_id").limit(k)


def find_next(docs: DataFrame, query: str, after: Column | int = 0) -> DataFrame:
    """Position (0-based) and line of the next hit at or after ``after``, wrapping to the start."""
    needle = F.lit(query.strip().lower())
    text = F.lower("text")
    start = (after if isinstance(after, Column) else F.lit(after)) + 1
    ahead = F.expr("locate(_needle, _text, _start)")
    rows = docs.withColumns({"_needle": needle, "_text": text, "_start": start.cast("int")})
    found = F.when(ahead > 0, ahead).otherwise(F.expr("locate(_needle, _text, 1)"))
    line = F.size(F.split(F.expr("left(text, _at - 1)"), "\n"))
    return (
        rows.withColumn("_at", found)
        .filter("_at > 0")
        .select("rec_id", (F.col("_at") - 1).alias("position"), line.alias("line"))
    )
