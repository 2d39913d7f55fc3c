"""Text expressions. Word characters are letters, numbers and the underscore of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmill.functions.udfs import nfkc_casefold

WORD = r"[\p{L}\p{N}_]"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# The same characters as a list.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def collapse_spaces(text: Column) -> Column:
    """Any run of Unicode white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def has_alnum(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def fold_yo(text: Column) -> Column:
    # Not translate, which makes a string of every character.
    return F.replace(text, F.lit("ё"), F.lit("е"))


def term_key_folded(folded: Column) -> Column:
    """The term key of text that is already compatibility-normalised and case-folded."""
    text = fold_yo(folded)
    text = F.replace(text, F.lit("+"), F.lit(" plus "))
    text = F.replace(text, F.lit("#"), F.lit(" sharp "))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def term_key(text: Column) -> Column:
    """Comparison key of a term or text: folded words separated by single spaces."""
    return term_key_folded(nfkc_casefold(text))


def compact(folded: Column) -> Column:
    """Folded text without anything but Latin and Cyrillic letters and digits."""
    # The complement spelled out: a negated class with Cyrillic ranges is ten times slower.
    return F.regexp_replace(fold_yo(folded), r"[\x00-/:-`{-\u042f\u0450-\x{10ffff}]+", "")


def quoted(term: Column) -> Column:
    """A regular expression that matches ``term`` literally."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word_count(text: Column, term: Column) -> Column:
    """Occurrences of ``term`` in ``text`` not touching a word character on either side."""
    pattern = F.concat(F.lit(rf"(?<!{WORD})"), quoted(term), F.lit(rf"(?!{WORD})"))
    return F.when(F.contains(text, term), F.regexp_count(text, pattern)).otherwise(F.lit(0))


def phrase_count(text: Column, phrase: Column) -> Column:
    """Non-overlapping, space-delimited occurrences of ``phrase`` in ``text``."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    needle = F.concat(F.lit(" "), phrase, F.lit(" "))
    removed = F.length(padded) - F.length(F.replace(padded, needle, F.lit("")))
    count = F.floor(removed / F.length(needle)).cast("int")
    return F.when((F.length(text) == 0) | (F.length(phrase) == 0), F.lit(0)).otherwise(count)

