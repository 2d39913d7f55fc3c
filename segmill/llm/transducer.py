"""A byte-level BPE tokenizer as a deterministic finite-state transducer that counts tokens.

Three machines run one behind the other and are compiled into one, whose
transitions read a character and carry a change of the number of tokens:

* The first takes the added tokens of the file (``<|endoftext|>``) out of the
  text. It holds back what may become one and hands it on when it does not.
* The second cuts the text into pieces by the vocabulary's pattern (see
  ``pretokens``). What its look-ahead needs is held back as well: the last
  white space of a run, and an apostrophe that may begin an ending.
* The third follows the merges within a piece. The tokens of every prefix of a
  piece end in one last token, and a sequence of tokens is what the merges give
  if every two neighbours are. So the last token of a longer prefix is the one
  whose beginning is the end of a prefix with a last token that fits before
  it. A state therefore knows, for each ending that a token can still grow
  from, what the last token before it allows and how the numbers of tokens
  differ. These are finitely many, whatever the length of the piece.

Two tokens fit side by side if no merge crosses the border between them. The
symbols at the border change with time, where time is the order of the merges,
so a crossing merge happens if both of its symbols stand there at its time. What
a token does not allow is thus a list of ``(symbol to its right, time)``; as an
ending grows, only the symbols that agree with it stay on the list, so most
states soon forget which token came before.

States are compiled when a text first reaches them and forgotten when they are
too many. A state is a plain value that text can be continued from elsewhere.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import groupby

from segmill.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, _classes
from segmill.llm.vocabularies import _byte_letters, added_tokens

#: States that a worker keeps (some 500 bytes each), and tokens whose merges it remembers.
KEPT, TOKENS = 80_000, 20_000
NOTHING, QUOTE = 4, 5  # besides the classes of characters: no open piece; an apostrophe that may begin an ending
#: Endings that an apostrophe takes, by their first letter: fixed values of the pattern.
_SHORT, _LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
_NEVER = 1 << 60
#: (end of the piece, ((length of an ending, what is not allowed from its start on, difference in count), ...)), the longest
#: ending first. The last one is empty and names the last token instead; here there is none yet.
_FRESH = (b"", ((0, b"", 0),))
START = ("", NOTHING, "", _FRESH)


class Merges:
    """The merges of a tokenizers JSON file: which tokens are made, and which fit side by side."""

    def __init__(self, raw: bytes) -> None:
        told, letters = json.loads(raw), _byte_letters()
        plain = lambda token: bytes(letters[x] for x in token)
        pairs = (x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"])
        self.times = {(plain(a), plain(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {plain(token) for token in told["model"]["vocab"] if all(x in letters for x in token)}
        self.beginnings = {token[:k] for token in self.tokens for k in range(1, len(token))}
        self.follows: dict[bytes, list[tuple[bytes, int]]] = {}
        for (a, b), time in self.times.items():
            self.follows.setdefault(a, []).append((b, time))
        self.known: dict[bytes, tuple | None] = {b"": ({}, {})}

    def _merged(self, token: bytes) -> tuple[list, list] | None:
        """The symbols at a token's left and right edge as ``(symbol, from, until)`` in the order of merges; None if it is never made."""
        parts = [token[k : k + 1] for k in range(len(token))]
        left, right = [[parts[0], -1, _NEVER]], [[parts[-1], -1, _NEVER]]
        while len(parts) > 1:
            time, k = min((self.times.get(pair, _NEVER), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if time == _NEVER:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            for edge, at in ((left, 0), (right, -1)):
                if edge[-1][0] != parts[at]:
                    edge[-1][2] = time
                    edge.append([parts[at], time, _NEVER])
        return left, right

    def made(self, token: bytes) -> tuple[dict, dict] | None:
        """The symbols at a token's left edge with their times, and by first byte the symbols and times not allowed after it."""
        if token not in self.known:
            if len(self.known) >= TOKENS:
                self.known = {b"": ({}, {})}
            edges = self._merged(token)
            if edges is not None:
                left = {symbol: (since, until) for symbol, since, until in edges[0]}
                barred = sorted({(b, time) for a, since, until in edges[1] for b, time in self.follows.get(a, ()) if since < time < until})
                edges = left, {k: tuple(part) for k, part in groupby(barred, lambda x: x[0][0])}
            self.known[token] = edges
        return self.known[token]

    def fits(self, barred: tuple, token: bytes) -> bool:
        """Whether no merge crosses the border before ``token``.

        Of equal merges the left one comes first, so one at the time when
        ``token`` itself would merge its first symbol still crosses.
        """
        made = self.made(token)
        if made is None:
            return False
        for symbol, time in barred:
            since, until = made[0].get(symbol, (_NEVER, _NEVER))
            if since < time <= until:
                return False
        return True

    def feed(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state after more of a piece, and by how much its number of tokens changed."""
        ending, marks = state
        total = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            ending += bytes([byte])
            change, last, grown = None, None, []
            *longer, (_, newest, differs) = marks
            for length, barred, differs in [*longer, (0, self.made(newest)[1].get(byte, ()), differs)]:
                token = ending[len(ending) - length - 1 :]
                if change is None and token in self.tokens and self.fits(barred, token):
                    change, last = differs + 1, token
                if token in self.beginnings:
                    if barred:
                        barred = tuple(x for x in barred if x[0].startswith(token) or token.startswith(x[0]))
                    grown.append((length + 1, barred, differs))
            if change is None:
                raise ValueError(f"no token of the vocabulary ends {ending!r}")
            marks = (*((length, barred, differs - change) for length, barred, differs in grown), (0, last, 0))
            ending = ending[len(ending) - marks[0][0] :]
            total += change
        return (ending, marks), total


class State(dict):
    """Transitions by character: the next state and the change of the count; missing ones are compiled."""

    __slots__ = ("owner", "value")

    def __init__(self, owner: Transducer, value: tuple) -> None:
        self.owner, self.value = owner, value

    def __missing__(self, letter: str) -> tuple[State, int]:
        value, change = self.owner.step(self.value, letter)
        out = self[letter] = self.owner.state(value), change
        return out


class Transducer:
    def __init__(self, raw: bytes) -> None:
        self.merges, self.added = Merges(raw), set(added_tokens(raw))
        if any(a != b and a in b for a in self.added for b in self.added):
            raise ValueError("an added token is part of another one, which is not supported")
        self.opening = {token[:k] for token in self.added for k in range(1, len(token))}
        self.states: dict[tuple, State] = {}

    def state(self, value: tuple) -> State:
        found = self.states.get(value)
        if found is None:
            if len(self.states) >= KEPT:
                for old in self.states.values():
                    old.clear()  # they name each other
                self.states = {}
            found = self.states[value] = State(self, value)
        return found

    def run(self, value: tuple, text: str) -> tuple[tuple, int]:
        """The state after a text and the change of the count."""
        state, total = self.state(value), 0
        for letter in text:
            state, change = state[letter]
            total += change
        return state.value, total

    def count(self, text: str) -> int:
        value, total = self.run(START, text)
        return total + self.finish(value)

    def step(self, value: tuple, letter: str) -> tuple[tuple, int]:
        held, *inner = value
        word = held + letter
        if word in self.added:
            return START, 1 + self.finish((held, *inner), released=True)
        keep = next(k for k in range(len(word) + 1) if k == len(word) or word[k:] in self.opening)
        total = 0
        for x in word[:keep]:
            inner, change = self._cut(*inner, x)
            total += change
        return (word[keep:], *inner), total

    def finish(self, value: tuple, released: bool = False) -> int:
        """The change of the count at the end of a text; ``released``: what is held back is an added token."""
        held, *inner = value
        total = 0
        for letter in "" if released else held:
            inner, change = self._cut(*inner, letter)
            total += change
        _, change = self._close(*inner)
        return total + change

    def _close(self, kind: int, pending: str, piece: tuple) -> tuple[tuple, int]:
        """Feed what is held back at the end of a text."""
        if kind != QUOTE:
            return self.merges.feed(piece, pending)
        return _FRESH, sum(self.merges.feed(_FRESH, x)[1] for x in pending)

    def _cut(self, kind: int, pending: str, piece: tuple, letter: str) -> tuple[tuple, int]:
        """The pattern's machine: ``kind`` of the open piece, what is held back of it, and the merges' state in it."""
        feed, now = self.merges.feed, int(_classes()[ord(letter)])
        if kind == SPACE:
            if now == SPACE:  # only the last one may belong to what follows
                piece, change = feed(piece, pending)
                return (SPACE, letter, piece), change
            if pending == " ":
                piece, change = feed(_FRESH, " " + letter)
                return (now, "", piece), change
            _, alone = feed(_FRESH, pending)
            state, change = self._cut(NOTHING, "", _FRESH, letter)
            return state, alone + change
        if kind == QUOTE:
            if (pending == "'" and letter in _SHORT) or _LONG.get(pending[1:]) == letter:
                return (NOTHING, "", _FRESH), feed(_FRESH, pending + letter)[1]
            if pending == "'" and letter in _LONG:
                return (QUOTE, pending + letter, _FRESH), 0
            piece, total = feed(_FRESH, "'")
            state = (OTHER, "", piece)
            for x in pending[1:] + letter:
                state, change = self._cut(*state, x)
                total += change
            return state, total
        if kind == now:
            piece, change = feed(piece, letter)
            return (kind, "", piece), change
        if now == SPACE:
            return (SPACE, letter, _FRESH), 0
        if letter == "'":
            return (QUOTE, letter, _FRESH), 0
        piece, change = feed(_FRESH, letter)
        return (now, "", piece), change


assert {OTHER, LETTER, NUMBER, SPACE}.isdisjoint({NOTHING, QUOTE})


@cache
def transducer(raw: bytes) -> Transducer:
    """One per worker."""
    return Transducer(raw)
