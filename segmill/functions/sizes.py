"""Byte counts as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit labels of the size text.
SIZE_UNITS = ("Б", "КБ", "МБ", "ГБ")


def size_text(size: Column) -> Column:
    value = size.cast("double")
    scaled = F.when(size.isNull() | (value == 0), F.lit(f"0 {SIZE_UNITS[0]}"))
    for power, unit in enumerate(SIZE_UNITS):
        text = F.concat(F.format_string("%.1f", value / 1024**power), F.lit(f" {unit}"))
        last = power == len(SIZE_UNITS) - 1
        scaled = scaled.otherwise(text) if last else scaled.when(value < 1024 ** (power + 1), text)
    return scaled
