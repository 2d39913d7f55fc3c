"""Caption files (VTT and SRT) as cue rows, and as plain reference text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions.arrays import let
from segmill.functions.text import WHITESPACE, collapse_spaces, strip
from segmill.functions.times import PLAIN_TIMING, parse_clock, plain_clock
from segmill.functions.udfs import html_unescape_each, html_unescape_join

# Markup patterns and the header lines of caption files.
POSITION_TAG = r"\{\\[^}]+\}"
TAG = r"<[^>]*>"
LOOSE_TAG = r"<[^>]+>"
INVISIBLE = r"[\u200b\u200e\u200f]"
HEADER_LINE = r"^(?:WEBVTT$|Kind:|Language:|NOTE)"
LINE_BREAK = r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per caption file; the file name is the recording."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("rec_id"), F.col("value").alias("content"))


def _unified(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"\r\n?", "\n"), r"^\uFEFF+", "")


def _first_word(text: Column) -> Column:
    return F.get(F.filter(F.split(text, WHITESPACE), lambda word: word != ""), F.lit(0))


def _cue(block: Column) -> Column:
    def parsed(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda line: F.contains(line, F.lit("-->"))), F.lit(True)).cast("int")
        return let(at, lambda at: let(F.get(lines, at - 1), lambda timing: timed(lines, at, timing)))

    def timed(lines: Column, at: Column, timing: Column) -> Column:
        times = lambda start, end: F.struct(start.alias("start_ms"), end.alias("end_ms"))
        begin = parse_clock(_first_word(F.split_part(timing, F.lit("-->"), F.lit(1))))
        stop = parse_clock(_first_word(F.regexp_replace(timing, r"^.*?-->", "")))
        plain = times(plain_clock(timing, 1), plain_clock(timing, 18))
        text = F.array_join(F.slice(lines, at + 1, F.size(lines)), " ")
        return let(
            F.when(timing.rlike(PLAIN_TIMING), plain).otherwise(times(begin, stop)),
            lambda t: F.struct(t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms"), text.alias("text")),
        )

    return let(F.transform(F.split(block, LINE_BREAK), strip), parsed)


def read_captions(files: DataFrame) -> DataFrame:
    """Cues of ``files(rec_id, content)``, numbered in time order inside the file.

    A cue is a blank-line separated block with a valid timing line; markup, entities
    and invisible characters are removed and empty cues dropped. All of it happens
    inside the row of the file, so nothing is shuffled.
    """
    blocks = F.split(_unified(F.col("content")), r"\n[ \t]*\n")
    cues = F.transform(F.filter(blocks, lambda block: F.contains(block, F.lit("-->"))), _cue)
    cues = F.filter(cues, lambda cue: cue["end_ms"] > cue["start_ms"])
    parsed = files.select("rec_id", cues.alias("cues"))
    # Most cues hold neither mark.
    marked = lambda text: F.contains(text, F.lit("<")) | F.contains(text, F.lit("{\\"))
    bare_text = lambda text: F.regexp_replace(F.regexp_replace(text, POSITION_TAG, ""), TAG, "")
    plain = F.transform("cues", lambda cue: F.when(marked(cue["text"]), bare_text(cue["text"])).otherwise(cue["text"]))
    # Python sees the files with entities only. A generated row keeps the arrays plain columns for it.
    bare = parsed.select("rec_id", F.inline(F.array(F.struct("cues", plain.alias("plain")))))
    entities = F.exists("plain", lambda text: F.contains(text, F.lit("&")))
    decoded = bare.withColumn("decoded", html_unescape_each(F.when(entities, F.col("plain"))))
    clean = let(
        F.coalesce("decoded", "plain"),
        lambda texts: F.transform(
            "cues",
            lambda cue, i: F.struct(
                cue["start_ms"].alias("start_ms"),
                cue["end_ms"].alias("end_ms"),
                i.alias("pos"),
                collapse_spaces(F.regexp_replace(F.get(texts, i), INVISIBLE, "")).alias("text"),
            ),
        ),
    )
    ordered = F.sort_array(F.filter(clean, lambda cue: cue["text"] != ""))
    return decoded.select("rec_id", F.posexplode(ordered).alias("cue_idx", "cue")).select(
        "rec_id", "cue_idx", "cue.start_ms", "cue.end_ms", "cue.text"
    )


def captions_to_reference_text(files: DataFrame) -> DataFrame:
    """The running text of a caption file for scoring; repeated lines stay."""
    lines = F.transform(F.split(_unified(F.col("content")), LINE_BREAK), strip)
    spoken = F.filter(
        lines,
        lambda line: (line != "")
        & ~line.rlike(HEADER_LINE)
        & ~F.contains(line, F.lit("-->"))
        & ~line.rlike(r"^\p{Nd}+$"),
    )
    bare = F.transform(spoken, lambda line: F.regexp_replace(line, LOOSE_TAG, ""))
    # Python sees the files with entities only, as one text each. One generated row per file keeps it a plain column.
    joined = files.select("rec_id", F.inline(F.array(F.struct(F.array_join(bare, "\n").alias("lines")))))
    text = F.array_join(F.filter(F.transform(F.split("lines", "\n"), strip), lambda line: line != ""), " ")
    entities = F.when(F.contains("lines", F.lit("&")), F.col("lines"))
    return joined.select("rec_id", F.coalesce(html_unescape_join(entities), text).alias("text"))
