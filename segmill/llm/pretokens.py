"""Splitting texts into the pieces that byte-level BPE merges within, as array arithmetic.

The pieces are the matches of this pattern (a fixed value of the vocabulary)::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point is a letter, a number, a space or something else. A piece
starts where that class changes, with two exceptions, which ``_starts`` adds:
the last space before a word joins it, and an apostrophe takes its short ending.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points of the pattern's ``\s``: fixed values.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters handled at once; a longer text is cut where a piece certainly starts.
CHUNK = 1 << 18
_CERTAIN = regex.compile(r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])")


@cache
def _classes() -> np.ndarray:
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")  # no object per character
    table = np.zeros(len(every), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            table[run.start() : run.end()] = kind
    table[list(SPACES)] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; ``first`` marks the first of each text."""
    size = len(points)
    kind = _classes()[points]
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    inside = np.zeros(size, bool)  # the next code point belongs to the same text
    inside[:-1] = ~first[1:]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inside[:-1])
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False

    quote = np.flatnonzero((points == 0x27) & starts & inside)
    after = points[quote + 1]
    one = quote[np.isin(after, [ord(x) for x in "stmd"])]
    two = quote[inside[quote + 1]]
    pair = points[two + 1].astype(np.uint64) << np.uint64(32) | points[np.minimum(two + 2, size - 1)]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    for found, length in ((one, 2), (two, 3)):
        for k in range(1, length):
            starts[found + k] = False
        starts[(found + length)[found + length < size]] = True
    return starts


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The pieces of some texts, each distinct one once.

    Returns the index of each piece's distinct form in order, the number of
    pieces of each text, and the distinct forms, which are told apart by their
    characters.
    """
    whole = "".join(texts)
    points = code_points(whole)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), []
    first = np.zeros(len(points), bool)
    first[(ends - sizes)[sizes > 0]] = True
    starts = _starts(points, first)
    begin = np.flatnonzero(starts)
    width = np.diff(begin, append=len(points))
    before = np.concatenate(([0], np.cumsum(starts)))
    codes, forms = _numbered(whole, points, begin, width)
    return codes, before[ends] - before[ends - sizes], forms


def _numbered(whole: str, points: np.ndarray, begin: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each piece's distinct form, and the forms.

    Up to seven code points below 256 and their number fill a 64-bit integer, so such
    pieces are told apart by integers that spell them out; others by their strings.
    """
    short = (width <= 7) & (np.add.reduceat(points > 255, begin) == 0)
    at, size = begin[short], width[short]
    padded = np.concatenate([points, np.zeros(7, points.dtype)]).astype(np.uint64)
    keys = size.astype(np.uint64) << np.uint64(56)
    for k in range(7):
        keys |= np.where(size > k, padded[at + k], np.uint64(0)) << np.uint64(8 * k)
    short_codes, uniques = pd.factorize(keys)
    seen = np.empty(len(uniques), np.int64)
    seen[short_codes[::-1]] = np.arange(len(short_codes) - 1, -1, -1)
    forms = [whole[a : a + n] for a, n in zip(at[seen].tolist(), size[seen].tolist(), strict=True)]
    others: dict[str, int] = {}
    number, known = others.setdefault, len(forms)
    long = [number(whole[a : a + n], known + len(others)) for a, n in zip(begin[~short].tolist(), width[~short].tolist(), strict=True)]
    codes = np.empty(len(begin), np.int64)
    codes[short], codes[~short] = short_codes, long
    return codes, [*forms, *others]


def chunks(rows: Iterable[tuple], limit: int = CHUNK) -> Iterator[tuple[list[tuple], list[str], list[bool]]]:
    """Groups of texts of about ``limit`` characters: their rows, texts, and whether each ends its row.

    ``rows`` are tuples whose last item is the text (null: empty). A longer text
    comes in several parts, cut where a run of letters or numbers ends.
    """
    keys, texts, ends, held = [], [], [], 0
    for *key, text in rows:
        text, at = text or "", 0
        while len(text) - at > limit and (cut := _CERTAIN.search(text, at + limit - 1)):
            keys.append(tuple(key)), texts.append(text[at : cut.start()]), ends.append(False)
            at = cut.start()
            yield keys, texts, ends
            keys, texts, ends, held = [], [], [], 0
        keys.append(tuple(key)), texts.append(text[at:] if at else text), ends.append(True)
        held += len(text) - at
        if held >= limit:
            yield keys, texts, ends
            keys, texts, ends, held = [], [], [], 0
    if keys:
        yield keys, texts, ends


def ragged(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated slices ``flat[offsets[c]:offsets[c + 1]]`` and where each one ends."""
    sizes = np.diff(offsets)[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[codes] - (ends - sizes), sizes) + np.arange(total)], ends


class Lexicon:
    """Numbers distinct pieces in order of first sight."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.numbers)

    def number(self, forms: list[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each of some distinct pieces, and those not seen before."""
        known, number = len(self), self.numbers.setdefault
        out = np.array([number(form, len(self.numbers)) for form in forms], np.int64)
        return out, [form for form, k in zip(forms, out.tolist(), strict=True) if k >= known]
