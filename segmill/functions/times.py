"""Media time: integer milliseconds from the start of the recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmill.functions.arrays import let

TIMESTAMP = r"^(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})$"


def to_ms(seconds: Column) -> Column:
    """Seconds to milliseconds, half to even."""
    return F.bround(seconds.cast("double") * 1000).cast("bigint")


def _part(total: Column, size: int) -> Column:
    return F.floor(total / size).cast("bigint")


def clock(ms: Column, separator: str | None = None) -> Column:
    """``HH:MM:SS`` (hours may pass 24), with ``separator`` and milliseconds if one is given."""
    total = F.greatest(F.lit(0), ms).cast("bigint")
    hours = _part(total, 3_600_000)
    minutes = _part(total, 60_000) % 60
    seconds = _part(total, 1000) % 60
    # Not format_string, which reads its format anew for every value.
    padded = lambda number, digits: F.lpad(number.cast("string"), digits, "0")
    hour = F.when(hours < 10, padded(hours, 2)).otherwise(hours.cast("string"))
    colon = F.lit(":")
    whole = (hour, colon, padded(minutes, 2), colon, padded(seconds, 2))
    return F.concat(*whole) if separator is None else F.concat(*whole, F.lit(separator), padded(total % 1000, 3))


def duration_text(seconds: Column, unknown: str = "Неизвестно") -> Column:
    """``HH:MM:SS`` from one hour on, else ``MM:SS``; null gives ``unknown``."""
    total = F.greatest(F.lit(0), seconds.cast("bigint"))
    hours = _part(total, 3600)
    minutes = _part(total, 60) % 60
    return (
        F.when(seconds.isNull(), F.lit(unknown))
        .when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, total % 60))
        .otherwise(F.format_string("%02d:%02d", minutes, total % 60))
    )


def parse_clock(text: Column) -> Column:
    """``[H:]MM:SS.mmm`` to milliseconds; null when it is not a valid time."""
    part = lambda text, k: F.regexp_extract(text, TIMESTAMP, k).try_cast("int")

    def fields(text: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, TIMESTAMP, 1).try_cast("bigint").alias("hours"),
            part(text, 2).alias("minutes"),
            part(text, 3).alias("seconds"),
            F.rpad(F.regexp_extract(text, TIMESTAMP, 4), 3, "0").try_cast("int").alias("millis"),
        )

    def total(at: Column) -> Column:
        whole = F.coalesce(at["hours"], F.lit(0)) * 3_600_000 + at["minutes"] * 60_000 + at["seconds"] * 1000 + at["millis"]
        return F.when((at["minutes"] < 60) & (at["seconds"] < 60), whole)

    # Each use of an expression evaluates it again, so the text and its fields are bound first.
    return let(text, lambda text: F.when(text.rlike(TIMESTAMP), let(fields(text), total)))


# How files write the time of a cue, nearly always.
PLAIN_TIMING = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3} --> [0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3}\z"


def plain_clock(text: Column, at: int) -> Column:
    """``parse_clock`` of the ``HH:MM:SS.mmm`` that begins at character ``at``."""
    part = lambda offset, length: F.substring(text, at + offset, length).cast("int")
    minutes, seconds = part(3, 2), part(6, 2)
    whole = part(0, 2).cast("bigint") * 3_600_000 + minutes * 60_000 + seconds * 1000 + part(9, 3)
    return F.when((minutes < 60) & (seconds < 60), whole)
