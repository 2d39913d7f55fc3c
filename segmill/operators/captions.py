"""Caption cues and tracks: de-rolling, track choice, track lists, choice of text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions.arrays import let
from segmill.functions.text import WHITESPACE
from segmill.functions.udfs import casefold
from segmill.operators.ordered import CHUNK_ROWS, Running, position_chunk, with_running
from segmill.session import checkpointed

# Neighbour tolerance, token pattern, safe language codes, track limits.
ROLLING_GAP_MS = 50
TOKEN_NOISE = r"[^\p{L}\p{N}_+#.\-]+"
SAFE_LANGUAGE = r"^[a-zA-Z]{2,8}(?:[-_][a-zA-Z0-9]{1,12})*$"
SAFE_LANGUAGE_LENGTH = 64
CAPTION_FORMATS = ("vtt", "srt")
MAX_TRACK_OPTIONS = 40
MAX_TRACK_LANGUAGE = 32
MAX_TRACK_NAME = 120


def _raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda token: token != "")


def _clean_tokens(folded: Column) -> Column:
    tokens = F.transform(F.split(folded, WHITESPACE), lambda token: F.regexp_replace(token, TOKEN_NOISE, ""))
    return F.filter(tokens, lambda token: token != "")


def _starts_with(tokens: Column, prefix: Column) -> Column:
    return (F.size(tokens) >= F.size(prefix)) & (F.slice(tokens, F.lit(1), F.size(prefix)) == prefix)


def _overlap(previous: Column, current: Column) -> Column:
    """The longest end of ``previous`` that is also the start of ``current``."""
    shorter = F.least(F.size(previous), F.size(current))
    lengths = F.when(shorter > 0, F.sequence(shorter, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    # Runs are only cut and compared where the current first word stands in the previous text.
    fits = F.filter(
        lengths,
        lambda k: (F.get(previous, F.size(previous) - k) == F.get(current, F.lit(0)))
        & (F.slice(previous, F.size(previous) - k + 1, k) == F.slice(current, F.lit(1), k)),
    )
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


def caption_actions(cues: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For each cue what the rolling-caption rule does with it, decided from the previous raw cue."""
    return _acted(cues, chunk_rows).drop("_chunk")


def _acted(cues: DataFrame, chunk_rows: int) -> DataFrame:
    paired = with_running(
        cues,
        ["rec_id"],
        ["cue_idx"],
        position_chunk("cue_idx", chunk_rows),
        {"prev": Running("last", F.struct("end_ms", "text"), inclusive=False)},
        dense=True,
        keep_chunk=True,
    )
    # Texts move, tokens are made where they lie, and once: only a chunk's first cue makes those of the cue before.
    tokens = lambda text: _clean_tokens(casefold(text))
    within = Window.partitionBy("rec_id", "_chunk").orderBy("cue_idx")
    paired = paired.withColumn("tokens", tokens(F.col("text"))).withColumn("before", F.lag("tokens").over(within))
    paired = paired.withColumn("before", F.coalesce("before", tokens(F.col("prev.text"))))
    previous, current = F.col("before"), F.col("tokens")
    rolling = F.coalesce(
        (F.col("start_ms") <= F.col("prev.end_ms") + ROLLING_GAP_MS) & (F.size(previous) > 0), F.lit(False)
    )

    def step(action: str, skipped: Column | int = 0) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(skipped).cast("int").alias("skipped"))

    def shifted(shared: Column) -> Column:
        counted = (shared >= 2) | ((shared == 1) & (F.length(F.element_at(previous, -1)) >= 4))
        return F.when(counted, step("shifted", shared)).otherwise(step("new"))

    # Both parts in one expression, so the texts are compared once.
    steps = (
        F.when(~rolling, step("new"))
        .when(current == previous, step("same"))
        .when(_starts_with(current, previous), step("grown", F.size(previous)))
        .when(_starts_with(previous, current), step("shrunk"))
        .otherwise(let(_overlap(previous, current), shifted))
    )
    paired = paired.withColumn("step", steps).withColumns({"action": F.col("step.action"), "skipped": F.col("step.skipped")})
    skipped = F.col("skipped")
    raw = _raw_tokens(F.col("text"))
    rest = F.array_join(F.slice(raw, skipped + 1, F.greatest(F.size(raw), F.lit(1))), " ")
    text = (
        F.when(F.col("action").isin("same", "shrunk"), F.lit(""))
        .when(F.col("action") == "new", F.col("text"))
        .otherwise(rest)
    )
    return paired.withColumn("new_text", text).drop("prev", "before", "tokens", "step", "skipped")


def dedupe_rolling_captions(cues: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Turn rolling captions into segments that say each word once.

    A cue equal to the one before only prolongs the last kept cue; a cue that
    continues it keeps the words not yet said.
    """
    kept = F.col("new_text") != ""
    cut = ["rec_id", "_chunk"]
    acted = _acted(cues, chunk_rows).withColumn("kept", kept).withColumn("counts", F.col("kept") | (F.col("action") == "same"))
    # Groups are made inside a chunk, where its cues lie; the first may go on with the last of an earlier chunk.
    upto = Window.partitionBy(*cut).orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, 0)
    grouped = acted.withColumn("group", F.coalesce(F.sum(F.col("kept").cast("int")).over(upto), F.lit(0)))
    head = F.max(F.when(F.col("kept"), F.struct("cue_idx", "start_ms", "new_text")))
    groups = grouped.groupBy(*cut, "group").agg(head.alias("head"), F.max(F.when(F.col("counts"), F.col("end_ms"))).alias("end_ms"))
    groups = checkpointed(groups.select(*cut, "group", "head.start_ms", "head.new_text", "end_ms"))
    carried = F.broadcast(_carried(groups))
    last = F.when(F.col("group") == F.col("groups"), F.col("until"))
    return (
        groups.filter(F.col("group") > 0)
        .join(carried, cut, "left")
        .select(
            "rec_id",
            (F.col("group") + F.coalesce("earlier", F.lit(0)) - 1).cast("int").alias("seg_idx"),
            "start_ms",
            F.greatest("end_ms", last).alias("end_ms"),
            F.col("new_text").alias("text"),
        )
    )


def _carried(groups: DataFrame) -> DataFrame:
    """What chunks tell each other: the groups in ``earlier`` chunks, and ``until`` when later ones prolong the chunk's last group.

    Chunks that are told nothing, as the only one of a recording, are left out.
    """
    leading = F.max(F.when(F.col("group") == 0, F.col("end_ms")))
    chunks = groups.groupBy("rec_id", "_chunk").agg(F.max("group").alias("groups"), leading.alias("leading"))
    before = Window.partitionBy("rec_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("groups") > 0, F.col("_chunk")), ignorenulls=True).over(before)
    told = chunks.withColumns({"earlier": F.sum("groups").over(before), "owner": owner})
    own = told.select("rec_id", "_chunk", "groups", "earlier", F.lit(None).cast("bigint").alias("until"))
    none = F.lit(None).cast("bigint")
    given = told.filter("owner IS NOT NULL AND leading IS NOT NULL").select(
        "rec_id", F.col("owner").alias("_chunk"), none.alias("groups"), none.alias("earlier"), F.col("leading").cast("bigint").alias("until")
    )
    both = own.unionByName(given).groupBy("rec_id", "_chunk").agg(*(F.max(x).alias(x) for x in ("groups", "earlier", "until")))
    return both.filter("earlier IS NOT NULL OR until IS NOT NULL")


# --- tracks -----------------------------------------------------------------------


def language_base(folded: Column) -> Column:
    return F.split_part(F.translate(folded, "_", "-"), F.lit("-"), F.lit(1))


def choose_subtitle_track(tracks: DataFrame, language: str = "auto", preferred: str = "ru") -> DataFrame:
    """One caption track per recording: preferred language first, manual before automatic.

    ``tracks`` has one row per listed variant: ``rec_id, kind, ord, language,
    variant_ord, ext, file_format, name``; ``ord`` is the position of the language
    inside its kind, ``file_format`` the format its extension or URL tells.
    """
    folded = F.lower(F.translate("language", "_", "-"))
    rows = tracks.filter(
        F.col("language").rlike(SAFE_LANGUAGE)
        & (F.length("language") <= SAFE_LANGUAGE_LENGTH)
        & F.col("file_format").isin(*CAPTION_FORMATS)
    ).withColumns({"code": folded, "base": language_base(folded), "automatic": F.col("kind") == "automatic"})

    def tier(wanted: str | None, number: int) -> Column:
        hit = F.lit(True) if wanted is None else F.col("base") == wanted.replace("_", "-").split("-")[0].lower()
        exact = F.lit(True) if wanted is None else F.col("code") == wanted.replace("_", "-").lower()
        order = F.when(exact & F.lit(wanted is not None), F.lit("")).otherwise(F.lower("language"))
        return F.when(hit, F.struct(
            (F.lit(number) + F.col("automatic").cast("int")).alias("tier"),
            (~exact).alias("variant"),
            order.alias("code"),
        ))

    wanted = language.strip() or "auto"
    best = tier(preferred, 0)
    if wanted == "auto":
        best = F.coalesce(best, tier(None, 2))
    elif wanted.replace("_", "-").split("-")[0].lower() != preferred:
        best = F.coalesce(best, tier(wanted, 2))
    format_rank = F.array_position(F.array(*[F.lit(f) for f in CAPTION_FORMATS]), F.col("file_format"))
    rank = F.struct("best", "ord", format_rank.alias("format_rank"), "variant_ord")
    return (
        rows.withColumn("best", best)
        .filter(F.col("best").isNotNull())
        .groupBy("rec_id")
        .agg(F.min_by(F.struct("language", "kind", "file_format", "name"), rank).alias("track"))
        .select("rec_id", "track.*")
    )


def list_subtitle_options(tracks: DataFrame) -> DataFrame:
    """Selectable caption languages of a recording: one per folded code and kind, best 40 in order."""
    code = F.trim("language")
    rows = tracks.withColumns({"language": code, "automatic": F.col("kind") == "automatic"}).filter(
        (F.col("language") != "") & (F.length("language") <= MAX_TRACK_LANGUAGE)
    )
    usable = F.lower("ext").isin(*CAPTION_FORMATS)
    named = F.trim("name")
    # Per listed code: is any variant usable, and the first non-empty name of its variants.
    listed = rows.groupBy("rec_id", "automatic", "ord", "language").agg(
        F.max(usable).alias("usable"),
        F.min(F.when(F.coalesce(named, F.lit("")) != "", F.struct("variant_ord", named.alias("name")))).alias("label"),
    ).filter("usable")
    label = F.substring(F.coalesce(F.col("label.name"), F.col("language")), 1, MAX_TRACK_NAME)
    first = listed.groupBy("rec_id", "automatic", F.lower("language").alias("code")).agg(
        F.min_by(F.struct("language", label.alias("name")), F.col("ord")).alias("track")
    )
    order = Window.partitionBy("rec_id").orderBy(~F.col("code").startswith("ru"), "automatic", "code")
    return (
        first.withColumn("option", F.row_number().over(order))
        .filter(F.col("option") <= MAX_TRACK_OPTIONS)
        .select("rec_id", "option", "track.language", "track.name", "automatic")
    )


# --- text source ------------------------------------------------------------------


def reconcile_text_source(
    recordings: DataFrame, captions: DataFrame, speech: DataFrame, source: str = "auto"
) -> tuple[DataFrame, DataFrame]:
    """Segments per recording from captions or speech, and a status row per recording.

    ``auto`` takes captions where they have text and speech elsewhere; ``subtitles``
    reports recordings without captions; ``speech`` never looks at captions.
    """
    if source not in ("auto", "subtitles", "speech"):
        raise ValueError("source must be auto, subtitles or speech")
    columns = ["rec_id", "seg_idx", "start_ms", "end_ms", "text"]
    wanted = recordings.select("rec_id").distinct()
    spoken = speech.select(*columns).join(wanted, "rec_id", "left_semi")
    with_text = captions.filter(F.trim("text") != "").select(*columns).join(wanted, "rec_id", "left_semi")
    if source == "speech":
        chosen = spoken.withColumn("source", F.lit("speech"))
    elif source == "subtitles":
        chosen = with_text.withColumn("source", F.lit("captions"))
    else:
        captioned = with_text.select("rec_id").distinct()
        rest = spoken.join(captioned, "rec_id", "left_anti")
        chosen = with_text.withColumn("source", F.lit("captions")).unionByName(
            rest.withColumn("source", F.lit("speech"))
        )
    per_rec = chosen.groupBy("rec_id").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("segments"))
    missing = "no_captions" if source == "subtitles" else "no_speech"
    status = wanted.join(per_rec, "rec_id", "left").select(
        "rec_id",
        "source",
        F.coalesce("segments", F.lit(0)).alias("segments"),
        F.when(F.col("source").isNull(), F.lit(missing)).alias("error"),
    )
    return chosen, status
