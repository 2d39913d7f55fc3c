"""Keyed state over rows that come late and out of order, under an event-time watermark.

A key's rows wait in a list until the watermark has passed them; an event-time timer
then hands them on in order of time and sequence number. What is handed on is final. Rows
that come after the watermark has passed their time are late: they change nothing and go
out as audit rows, so none is lost silently. A second timer forgets a key that has
been silent for its lifetime, which bounds the state of a stream without end.

Keys share ``BUCKETS`` keyed states by their hash: a call into Python, its timer and its
result frame serve all keys of a bucket, while each key's own state is an entry of a
map. A bucket holds the rows of the watermark's delay (and of the batch at hand) at once;
how many rows a batch brings is set by the source's trigger limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: How late a row may be, and how long a silent key is remembered after its last row.
WATERMARK = "10 minutes"
LIFETIME_MS = 24 * 3_600_000

#: Keyed states that all keys are dealt to, and rows of a result frame.
BUCKETS, FRAME_ROWS = 1024, 10_000


def event_time(events: DataFrame, delay: str, *columns: Column | str) -> DataFrame:
    """The key and value columns of a stream with ``at_ms``, its event time, behind a watermark on ``ts``.

    The time itself stays behind: a stateful operator that saw it would drop late rows
    without a word, and these go to the audit instead. Rows without a time cannot be ordered
    and count as late.
    """
    at = F.coalesce(F.unix_millis("ts"), F.lit(-1)).alias("at_ms")
    return events.withWatermark("ts", delay).select(*columns, at)


def plain(value):
    """A frame's value as a state store takes it: missing ones None, numbers as Python's own."""
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


class InOrder(StatefulProcessor):
    """Base of processors that take each key's rows in order.

    ``KEY`` names the columns of a key, ``ROW`` those of a waiting row, the time and the
    sequence number first, and ``FIELDS`` those that are remembered of a key, with their types.
    A subclass takes rows in ``apply`` and, if it answers at once, shows in ``preview`` what
    the state would be with the rows that still wait; both return the key's new state
    (None: none) and result rows. ``audit`` makes the result rows of late ones, ``frame`` a
    frame of result rows.
    """

    KEY: dict[str, str] = {}
    ROW: dict[str, str] = {"at_ms": "bigint", "seq": "bigint"}
    FIELDS: dict[str, str] = {}
    PREVIEWS = False

    def __init__(self, lifetime_ms: int | None):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        def told(columns: dict[str, str]) -> str:
            return ", ".join(f"{name} {kind}" for name, kind in columns.items())

        self.handle = handle
        self.waiting = handle.getListState("waiting", told(self.KEY | self.ROW))
        # When the next waiting row is due, and when the next key may be forgotten.
        self.clock = handle.getValueState("clock", "due_ms bigint, silent_ms bigint")
        self.kept = handle.getMapState("kept", told(self.KEY), told({"last_ms": "bigint"} | self.FIELDS))

    def apply(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def preview(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def audit(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, width = max(timerValues.getCurrentWatermarkInMs(), 0), len(self.KEY)
        touched, first = set(), None
        for frame in rows:
            held, late = [], []
            for row in zip(*(frame[name] for name in (*self.KEY, *self.ROW)), strict=True):
                row = tuple(map(plain, row))
                (late if row[width] <= passed else held).append(row)
            if held:
                self.waiting.appendList(held)
                first = min(row[width] for row in held) if first is None else min(first, *(row[width] for row in held))
                touched.update(row[:width] for row in held)
            yield from self._frames(self.audit(own, late) for own, late in self._by_key(late).items())
        if first is None:
            return
        due, silent = self.clock.get() if self.clock.exists() else (None, None)
        if due is None or first < due:
            self.handle.registerTimer(first)
            self.clock.update((first, silent))
        if self.PREVIEWS:
            found = self._by_key(row for row in self.waiting.get() if tuple(row[:width]) in touched)
            yield from self._frames(self._step(self.preview, own, own_rows) for own, own_rows in found.items())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, width = timerValues.getCurrentWatermarkInMs(), len(self.KEY)
        due, silent = self.clock.get() if self.clock.exists() else (None, None)
        if due is not None and due <= passed:
            ready, rest = [], []
            for row in self.waiting.get():
                (ready if row[width] <= passed else rest).append(tuple(row))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield from self._frames(self._step(self.apply, own, rows) for own, rows in self._by_key(ready).items())
            due = min((row[width] for row in rest), default=None)
            if due is not None:
                self.handle.registerTimer(due)
            if self.lifetime_ms is not None and ready:
                ends = min(row[width] for row in ready) + self.lifetime_ms
                if silent is None or ends < silent:
                    silent = ends
                    if silent > passed:
                        self.handle.registerTimer(silent)
        if silent is not None and silent <= passed:
            silent = self._forget(passed)
            if silent is not None:
                self.handle.registerTimer(silent)
        self.clock.update((due, silent))

    def _forget(self, passed: int) -> int | None:
        """Forget the keys that are silent for their lifetime; returns when the next one may be."""
        busy = {tuple(row[: len(self.KEY)]) for row in self.waiting.get()} if self.waiting.exists() else set()
        ends = [(tuple(key), state[0] + self.lifetime_ms) for key, state in self.kept.iterator() if tuple(key) not in busy]
        for key, end in ends:
            if end <= passed:
                self.kept.removeKey(key)
        return min((end for _, end in ends if end > passed), default=None)

    def _step(self, take, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Hand a key's state and rows to ``apply`` or ``preview`` and keep the state; returns the result rows."""
        old = self.kept.getValue(key)
        last, state = (-1, None) if old is None else (old[0], tuple(old[1:]))
        new, out = take(key, state, rows)
        if take == self.apply:
            last = max(last, rows[-1][0])
        if new is not None:
            self.kept.updateValue(key, (last, *new))
        elif old is not None:
            self.kept.removeKey(key)
        return out

    def _by_key(self, rows) -> dict[tuple, list[tuple]]:
        """Rows without their key by key, each key's in order of time and sequence number."""
        found: dict[tuple, list[tuple]] = {}
        for row in rows:
            found.setdefault(tuple(row[: len(self.KEY)]), []).append(tuple(row[len(self.KEY) :]))
        for own in found.values():
            own.sort(key=lambda row: (row[0], row[1] is not None, row[1] or 0))
        return found

    def _frames(self, parts) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for part in parts:
            held += part
            if len(held) >= FRAME_ROWS:
                yield self.frame(held)
                held = []
        if held:
            yield self.frame(held)

    def close(self) -> None:
        pass


def in_event_time(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    if isinstance(processor, InOrder):
        rows, keys = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))), ["_bucket"]
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="EventTime"
    )


def settled(rows: DataFrame) -> DataFrame:
    """The rows of a stateful operator's output without its audit rows."""
    return rows.filter(~F.col("late")).drop("late", "at_ms")


def late_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The audit of late rows: ``keys``, ``seq`` and ``at_ms`` of the rows that came after the watermark."""
    seq = "seq" if "seq" in rows.columns else "last_seq"
    return rows.filter("late").select(*keys, F.col(seq).alias("seq"), "at_ms")
