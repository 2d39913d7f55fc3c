"""Byte-level BPE vocabularies inside tasks, from the bytes of their files."""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np
import tiktoken

from segmill.llm.pretokens import Lexicon, pieces, ragged

#: Bytes of memory for the pieces that a worker remembers with their ids, and for each piece besides its letters.
REMEMBERED, _EACH = 20_000_000, 180


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a JSON vocabulary: itself if printable, else the next above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


@cache
def ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file or of a tokenizers JSON file, without special tokens."""
    if not raw.lstrip().startswith(b"{"):
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    told, letters = json.loads(raw), _byte_letters()
    special = {x["id"] for x in told["added_tokens"]}
    return {bytes(letters[x] for x in token): k for token, k in told["model"]["vocab"].items() if k not in special}


@cache
def added_tokens(raw: bytes) -> dict[str, int]:
    """Strings that a tokenizers JSON file takes out of a text before anything else, and their ids."""
    if not raw.lstrip().startswith(b"{"):
        return {}
    told = json.loads(raw)["added_tokens"]
    for token in told:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} takes its surroundings into account, which is not supported")
    return {token["content"]: token["id"] for token in told}


@cache
def _added_pattern(raw: bytes) -> re.Pattern | None:
    known = added_tokens(raw)
    return re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True)))) if known else None


def segments(raw: bytes, text: str) -> list[tuple[str, int | None]]:
    """The parts of a text between added tokens, each with the id of the token after it (the last one: None)."""
    out, at, pattern = [], 0, _added_pattern(raw)
    for found in pattern.finditer(text) if pattern else ():
        out.append((text[at : found.start()], added_tokens(raw)[found[0]]))
        at = found.end()
    return [*out, (text[at:] if at else text, None)]


@cache
def encoding(raw: bytes) -> tiktoken.Encoding:
    import public_tokenizers

    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(raw), special_tokens={})


@cache
def token_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in order of the ids, and where each id's bytes begin."""
    table = sorted(ranks(raw).items(), key=lambda item: item[1])
    held = dict((k, token) for token, k in table)
    each = [held.get(k, b"") for k in range(max(held) + 1)]
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in each])))


def decode(raw: bytes, ids: np.ndarray) -> bytes:
    flat, offsets = token_bytes(raw)
    return ragged(flat, offsets, ids.astype(np.int64))[0].tobytes()


class PieceEncoder:
    """Encodes texts, merging within each distinct piece once as long as it is remembered."""

    def __init__(self, raw: bytes) -> None:
        self.encoding = encoding(raw)
        self._forget()

    def _forget(self) -> None:
        self.seen, self.flat, self.ends, self.held = Lexicon(), np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        codes, counts, forms = pieces(texts)
        if self.held > REMEMBERED:
            self._forget()
        numbers, new = self.seen.number(forms)
        self.held += sum(_EACH + 4 * len(form) for form in new)
        fresh = [self.encoding.encode_ordinary(form) for form in new]
        self.flat = np.concatenate([self.flat, np.array([x for ids in fresh for x in ids], np.uint32)])
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        flat, ends = ragged(self.flat, self.ends, numbers[codes])
        until = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return flat, np.diff(until)


@cache
def piece_encoder(raw: bytes) -> PieceEncoder:
    """One per worker, so that what it remembers serves later tasks too."""
    return PieceEncoder(raw)
