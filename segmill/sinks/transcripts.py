"""Transcripts as Markdown, text, SRT and VTT; evaluation reports as JSON.

A document is a sequence of units (header, paragraphs, captions) separated by blank
lines. Units stay rows, so a recording of any length is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions.text import collapse_spaces
from segmill.functions.times import clock
from segmill.operators.ordered import CHUNK_ROWS, Running, position_chunk, with_running
from segmill.operators.segments import number_blocks
from segmill.sinks.files import read_files, write_files

# Labels of the Markdown header.
NO_AUTHOR = "Не указан"
AUTHOR_LABEL = "Автор"
DURATION_LABEL = "Продолжительность"
LANGUAGE_LABEL = "Язык"
MODEL_LABEL = "Модель распознавания"
DATE_LABEL = "Дата транскрибации"
TRANSCRIPT_TITLE = "Транскрибация"
DEFAULT_SOURCE_LABEL = "Ссылка"
FORMATS = ("md", "txt", "srt", "vtt")


def _speaker_prefix(left: str = "", right: str = ": ") -> Column:
    name = collapse_spaces(F.col("speaker").cast("string"))
    return F.when(
        F.coalesce(F.col("speaker").cast("string"), F.lit("")) != "", F.concat(F.lit(left), name, F.lit(right))
    ).otherwise("")


def _unit(df: DataFrame, fmt: str, unit: Column, text: Column) -> DataFrame:
    return df.select("rec_id", F.lit(fmt).alias("format"), unit.cast("bigint").alias("unit"), text.alias("text"))


def markdown_units(blocks: DataFrame, recordings: DataFrame, include_timestamps: bool = True) -> DataFrame:
    def item(label: Column | str, value: Column) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.concat(F.lit("- "), label, F.lit(": "), value)

    author = F.when(F.coalesce("author", F.lit("")) != "", F.col("author")).otherwise(NO_AUTHOR)
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), collapse_spaces(F.col("title"))),
        F.lit(""),
        item(collapse_spaces(F.coalesce("source_label", F.lit(DEFAULT_SOURCE_LABEL))), collapse_spaces(F.col("source_url"))),
        item(AUTHOR_LABEL, collapse_spaces(author)),
        item(DURATION_LABEL, collapse_spaces(F.col("duration_text"))),
        item(LANGUAGE_LABEL, collapse_spaces(F.col("language"))),
        item(MODEL_LABEL, collapse_spaces(F.col("model"))),
        item(DATE_LABEL, F.date_format("created_at", "dd.MM.yyyy HH:mm")),
        F.lit(""),
        F.lit(f"## {TRANSCRIPT_TITLE}"),
    )
    body = F.concat(_speaker_prefix("**", ":** "), F.col("text"))
    if include_timestamps:
        body = F.concat(F.lit("### "), clock(F.col("start_ms")), F.lit("\n\n"), body)
    return _unit(recordings, "md", F.lit(0), header).unionByName(_unit(blocks, "md", F.col("first_seg") + 1, body))


def text_units(blocks: DataFrame, include_timestamps: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    body = F.concat(_speaker_prefix(), F.col("text"))
    if include_timestamps:
        body = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("]\n"), body)
    return _unit(number_blocks(blocks, chunk_rows), "txt", F.col("block_idx"), body)


def _times(separator: str) -> Column:
    return F.concat(clock(F.col("start_ms"), separator), F.lit(" --> "), clock(F.col("end_ms"), separator))


def srt_units(segments: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    numbered = with_running(
        segments, ["rec_id"], ["seg_idx"], position_chunk("seg_idx", chunk_rows), {"number": Running("sum", F.lit(1))}, dense=True
    )
    body = F.concat(
        F.col("number").cast("string"), F.lit("\n"), _times(","), F.lit("\n"), _speaker_prefix(), F.col("text")
    )
    return _unit(numbered, "srt", F.col("number") - 1, body)


def vtt_units(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    body = F.concat(_times("."), F.lit("\n"), _speaker_prefix(), F.col("text"))
    return _unit(recordings, "vtt", F.lit(0), F.lit("WEBVTT")).unionByName(
        _unit(segments, "vtt", F.col("seg_idx") + 1, body)
    )


def transcript_units(
    segments: DataFrame,
    blocks: DataFrame,
    recordings: DataFrame,
    formats: tuple[str, ...] = FORMATS,
    include_timestamps: bool = True,
) -> DataFrame:
    """Units of all asked formats: ``rec_id, format, unit, text``; unit 0 opens a document."""
    unknown = set(formats) - set(FORMATS)
    if unknown or not formats:
        raise ValueError(f"formats must be some of {', '.join(FORMATS)}")
    made = {
        "md": lambda: markdown_units(blocks, recordings, include_timestamps),
        "txt": lambda: text_units(blocks, include_timestamps),
        "srt": lambda: srt_units(segments),
        "vtt": lambda: vtt_units(segments, recordings),
    }
    parts = [made[fmt]() for fmt in FORMATS if fmt in formats]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def document_parts(units: DataFrame, units_per_part: int = 20_000) -> DataFrame:
    """Documents as text, cut into parts of bounded size; parts concatenated in order are the document. Ids are not null."""
    units = units.withColumn("part", F.floor(F.col("unit") / F.lit(units_per_part)).cast("int"))
    cut = ["rec_id", "format", "part"]
    ordered = F.array_sort(F.collect_list(F.struct("unit", "text")))
    body = F.array_join(F.transform(ordered, lambda u: u["text"]), "\n\n")
    # The texts move once, to their part; which parts there are is told by rows without texts. Of these only those of
    # documents in several parts are sent, at most two for each full part; the others are part 0 and the last.
    document = Window.partitionBy("rec_id", "format").orderBy("part")
    places = units.select(*cut).distinct().withColumns(
        {"number": F.row_number().over(document) - 1, "final": F.lead("part").over(document).isNull()}
    )
    places = F.broadcast(places.filter((F.col("number") != F.col("part")) | (F.col("number") > 0) | ~F.col("final")))
    parts = units.groupBy(*cut).agg(body.alias("body")).join(places, cut, "left")
    parts = parts.withColumns({"part": F.coalesce("number", F.lit(0)), "final": F.coalesce("final", F.lit(True))})
    content = F.concat(
        F.when(F.col("part") > 0, "\n\n").otherwise(""), F.col("body"), F.when(F.col("final"), "\n").otherwise("")
    )
    return parts.select("rec_id", "format", "part", content.alias("content"))


def _file_name() -> Column:
    """``rec_id.format``, later parts ``rec_id.part00001.format``; bytes of an id outside ``A-Za-z0-9-`` become ``~2F`` and so on."""
    plain = F.regexp_replace(F.url_encode("rec_id"), r"\+", "%20")
    for mark in "._*":
        plain = F.replace(plain, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    name = F.when(F.col("rec_id") == "", "~").otherwise(F.replace(plain, F.lit("%"), F.lit("~")))
    return F.concat(name, F.when(F.col("part") > 0, F.format_string(".part%05d", "part")).otherwise(""), F.lit("."), F.col("format"))


def write_transcripts(units: DataFrame, path: str, mode: str = "error", units_per_part: int = 20_000) -> None:
    """Write each document as one file below the folder ``path``, a long one as several whose names sort in order.

    ``mode`` as in ``write_files``. An id must not be null and, with its escapes, fit a file name.
    """
    parts = document_parts(units, units_per_part)
    write_files(parts.select(_file_name().alias("name"), "content"), path, mode)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``rec_id, format, part, content`` of a folder that ``write_transcripts`` has filled."""
    pieces = F.split("name", r"\.")
    bare = F.url_decode(F.replace(F.get(pieces, F.lit(0)), F.lit("~"), F.lit("%")))
    later = F.regexp_extract("name", r"\.part(\d+)\.", 1)
    return read_files(spark, path).select(
        F.when(F.startswith("name", F.lit("~.")), "").otherwise(bare).alias("rec_id"),
        F.element_at(pieces, -1).alias("format"),
        F.when(later == "", 0).otherwise(F.try_to_number(later, F.lit("999999999"))).cast("int").alias("part"),
        "content",
    )


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """Evaluation rows as JSON lines."""
    df.write.mode(mode).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The JSON texts of a written report as ``report``."""
    return spark.read.text(path).withColumnRenamed("value", "report")
