"""The scalar functions Spark has no built-in for: folding and normalising by the ICU library that Spark brings, the others on Arrow batches."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _folded(value):
    return None if value is None else unicodedata.normalize("NFKC", value).casefold()


@F.pandas_udf(StringType())
def _folded_texts(text: pd.Series) -> pd.Series:
    return text.map(_folded, na_action="ignore")


def _fold(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def _compose(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _unless_ascii(text: Column, plain: Column, other: Column) -> Column:
    # As many bytes as characters: ASCII, which a null is not.
    return F.when(F.octet_length(text) == F.length(text), plain).when(text.isNotNull(), other)


def nfkc(text: Column) -> Column:
    """The compatibility composition, as ``unicodedata.normalize``; no row leaves the JVM."""
    return _unless_ascii(text, text, _compose(text))


def nfkc_casefold(text: Column) -> Column:
    return _unless_ascii(text, F.lower(text), _fold(_compose(text)))


def casefold(text: Column) -> Column:
    """Full case folding, as ``str.casefold``; no row leaves the JVM."""
    return _unless_ascii(text, F.lower(text), _fold(text))


def casefold_each(texts: Column | str) -> Column:
    return F.transform(texts, casefold)


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def html_unescape_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda items: [html.unescape(item) for item in items], na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape_join(lines: pd.Series) -> pd.Series:
    """The lines of a text decoded, stripped and, unless empty, joined by spaces."""
    decoded = lambda text: (html.unescape(line).strip() for line in text.split("\n"))
    return lines.map(lambda text: " ".join(line for line in decoded(text) if line), na_action="ignore")


def register(spark) -> None:
    """Make the scalar functions available to SQL text."""
    spark.udf.register("nfkc_casefold", _folded_texts)
    spark.udf.register("html_unescape", html_unescape)
