"""Chat formatting by token-level assembly.

A formatted turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>``. Role and text
are encoded separately and the control strings are spliced in as reserved ids,
so no text can merge with or become a control token. A control string inside a
role or text is also broken up in writing: every backslash is doubled and one
backslash follows the first character of the control string. The loss mask
covers the text of assistant turns; segment sizes summed up give its place in
the turn, turn sizes summed up its place in the conversation.

Defined results: null roles and texts are empty. Rows of a conversation are
ordered by turn, then role, then ids; repeated rows are turns of their own, a
null conversation id or turn is a value like others. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm.vocabularies import decode, encoding, ranks

OPEN, BEGIN, END, CLOSE = CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
_CONTROL = re.compile("|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TRAINED_ROLE = "assistant"
#: Turns of a conversation that are summed in one group.
TURNS = 256


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reserved(raw: bytes) -> list[int]:
    """The ids of ``CONTROLS``: the first ones beyond the vocabulary and its one free id."""
    start = max(ranks(raw).values()) + 2
    return list(range(start, start + len(CONTROLS)))


def _encode_turns(vocabulary: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary.value
        known, (open_id, begin, end, close) = encoding(raw), reserved(raw)
        for batch in batches:
            ids, sizes, chars, loss_start, loss_end = [], [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                role, text = escape(role or ""), escape(text or "")
                segments = [[open_id], known.encode_ordinary(role), [begin], known.encode_ordinary(text), [end, close]]
                ends = np.cumsum([len(x) for x in segments]).tolist()
                trained = role == TRAINED_ROLE
                ids.append(np.array([x for part in segments for x in part], "<u4").tobytes())
                sizes.append(ends[-1]), chars.append(len(role) + len(text) + sum(map(len, CONTROLS)))
                loss_start.append(ends[2] if trained else None), loss_end.append(ends[3] if trained else None)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())]
            columns += [pa.array(x, pa.int64()) for x in (sizes, chars, loss_start, loss_end)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "ids", "n_ids", "n_chars", "loss_start", "loss_end"])

    return each


def format_turns(conversations: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """A row per turn: ``conv_id, turn, role, ids, n_ids, n_chars, id_offset, char_offset, loss_start, loss_end``.

    ``ids`` holds little-endian unsigned 32-bit numbers; the offsets are the
    turn's place in its conversation, the loss span (null: none) is in ids of
    the conversation. A conversation's turns are summed in groups of
    ``TURNS``, whose totals are summed in turn.
    """
    kinds = [conversations.schema[x].dataType.simpleString() for x in ("conv_id", "turn")]
    schema = f"conv_id {kinds[0]}, turn {kinds[1]}, role string, ids binary, n_ids long, n_chars long, loss_start long, loss_end long"
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    turns = turns.mapInArrow(_encode_turns(vocabulary), schema)
    turns = turns.withColumn("_group", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "_group").orderBy("turn", "role", "ids").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, over) -> Column:
        return F.coalesce(F.sum(column).over(over), F.lit(0))

    groups = turns.groupBy("conv_id", "_group").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_chars").alias("n_chars"))
    groups = groups.select(
        F.col("conv_id").alias("_conv"), F.col("_group").alias("_own"), before("n_ids", earlier).alias("_ids"), before("n_chars", earlier).alias("_chars")
    )
    turns = turns.withColumns({"id_offset": before("n_ids", inside), "char_offset": before("n_chars", inside)})
    joined = turns.join(groups, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_group").eqNullSafe(F.col("_own")))
    start = F.col("id_offset") + F.col("_ids")
    return joined.select(
        "conv_id", "turn", "role", "ids", "n_ids", "n_chars",
        start.alias("id_offset"), (F.col("char_offset") + F.col("_chars")).alias("char_offset"),
        (F.col("loss_start") + start).alias("loss_start"), (F.col("loss_end") + start).alias("loss_end"),
    )


class _Conversation:
    """Digests of one conversation, turn by turn: nothing grows with its length."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_back(turns: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """What the formatted ids and masks say, per conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    A digest reads a conversation in order, so one task streams it; it holds a
    batch of turns and the digests' state.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, now, done = vocabulary.value, None, []
        open_id, begin, end, close = reserved(raw)

        def text(ids: np.ndarray) -> str:
            return decode(raw, ids).decode("utf-8", "surrogatepass")

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv_id, ids, offset, start, stop in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [] if now is None else [now.row()]
                    now = _Conversation(conv_id)
                ids = np.frombuffer(ids, "<u4")
                at = {k: int(np.flatnonzero(ids == k)[0]) for k in (open_id, begin, end, close)}
                role, body = text(ids[at[open_id] + 1 : at[begin]]), text(ids[at[begin] + 1 : at[end]])
                now.turns += 1
                now.chars += len(role) + len(body) + sum(map(len, CONTROLS))
                now.turns_sha.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    trained = unescape(text(ids[start - offset : stop - offset]))
                    now.loss += len(trained)
                    now.loss_sha.update(trained.encode("utf-8", "surrogatepass"))
            if done:
                yield batch_of(done)
                done = []
        if now is not None:
            yield batch_of([now.row()])

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "ids", "id_offset", "loss_start", "loss_end").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "id_offset")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(each, schema)
