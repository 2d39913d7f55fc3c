"""Extractor metadata (one JSON document per recording) as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import urls
from segmill.functions.times import duration_text
from segmill.schemas import MEDIA_METADATA

# Fixed value: title of a recording that has none.
UNTITLED = "Без названия"


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def parse_media_metadata(df: DataFrame, json_column: str = "json") -> DataFrame:
    """``info`` struct per row; fields of a wrong type become null instead of failing the row."""
    return df.withColumn(
        "info", F.from_json(json_column, MEDIA_METADATA, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    ).drop(json_column)


def recordings(parsed: DataFrame) -> DataFrame:
    info = F.col("info")
    duration = info["duration"]
    return parsed.select(
        "rec_id",
        F.coalesce(_filled(info["title"]), F.lit(UNTITLED)).alias("title"),
        F.coalesce(_filled(info["channel"]), info["uploader"]).alias("author"),
        info["thumbnail"].alias("thumbnail"),
        info["webpage_url"].alias("source_url"),
        duration.cast("bigint").alias("duration_s"),
        duration_text(duration).alias("duration_text"),
        info["description"].alias("description"),
        info["tags"].alias("tags"),
        info["categories"].alias("categories"),
    )


def formats(parsed: DataFrame) -> DataFrame:
    """One row per listed media format; ``ord`` is its list position."""
    return parsed.select("rec_id", F.posexplode("info.formats").alias("ord", "f")).select("rec_id", "ord", "f.*")


def tracks(parsed: DataFrame) -> DataFrame:
    """One row per caption variant of both kinds, in listed order."""
    parts = []
    for kind, field in (("manual", "subtitles"), ("automatic", "automatic_captions")):
        listed = parsed.select("rec_id", F.posexplode(F.map_entries(f"info.{field}")).alias("ord", "entry"))
        parts.append(
            listed.select(
                "rec_id",
                F.lit(kind).alias("kind"),
                "ord",
                F.col("entry.key").alias("language"),
                F.posexplode("entry.value").alias("variant_ord", "v"),
            )
        )
    rows = parts[0].unionByName(parts[1])
    return rows.select(
        "rec_id", "kind", "ord", "language", "variant_ord", F.col("v.ext").alias("ext"),
        track_format(F.col("v.ext"), F.col("v.url")).alias("file_format"), F.col("v.name").alias("name"),
    )


def track_format(ext: Column, url: Column) -> Column:
    """The caption format by extension, else by the suffix of the URL path."""
    known = lambda c: F.when(c.isin("vtt", "srt"), c)
    plain = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", "")
    suffix = F.regexp_extract(F.lower(urls.path(url)), r"[^/.][^/]*\.([^./]+)$", 1)
    return F.coalesce(known(plain), known(suffix))
