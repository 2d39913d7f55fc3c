"""Keyed state over event streams: stream candidates per tab, tasks, jobs, submissions.

Use with the RocksDB state store. Rows may come late by the watermark's delay and in any
order; see ``ordered`` for what waits, what is final and what is audited. Every batch
emits the state of the keys it changed (update mode), rows that still wait included; of a
key the rows with the highest ``version`` are the state. Audit rows have ``late`` set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from segmill.operators.requests import MAX_CANDIDATES, media_priority
from segmill.schemas import TASK_COUNTERS
from segmill.streaming.ordered import LIFETIME_MS, STATE_STORE, WATERMARK, InOrder, event_time, in_event_time, plain

__all__ = ["STATE_STORE", "job_state_stream", "submit_once_stream", "task_state_stream", "track_stream_candidates"]


class CandidateTracker(StatefulProcessor):
    """Per tab the best candidates since the last page change.

    Each row is merged by its own sequence number, so rows may come in any order and
    are taken frame by frame; a batch cuts to the best once all its rows are merged.
    """

    COLUMNS = ["tab_id", "last_seq", "version", "rank", "url", "content_type", "headers", "priority", "detected_ms", "late", "at_ms"]

    def __init__(self, keep: int, lifetime_ms: int | None):
        self.keep, self.lifetime_ms = keep, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reset = handle.getValueState("reset", "seq bigint")
        self.seen = handle.getValueState("seen", "last_seq bigint, version bigint, last_ms bigint, timer_ms bigint")
        self.urls = handle.getMapState(
            "urls",
            "url string",
            "seq bigint, detected_ms bigint, priority int, content_type string, headers string, headers_seq bigint",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = max(0, timerValues.getCurrentWatermarkInMs())
        reset = self.reset.get()[0] if self.reset.exists() else -1
        known = {entry[0][0]: tuple(entry[1]) for entry in self.urls.iterator()}
        before = dict(known)
        last, version, newest_ms, timer = self.seen.get() if self.seen.exists() else (-1, 0, -1, None)
        taken = False
        for frame in rows:
            late = frame[frame["at_ms"] <= passed]
            if len(late):
                yield self._frame([(*key, int(s), 0, -1, None, None, None, 0, None, True, int(t)) for s, t in zip(late["seq"], late["at_ms"])])
            for row in frame[frame["at_ms"] > passed].itertuples(index=False):
                taken, last, newest_ms = True, max(last, int(row.seq)), max(newest_ms, int(row.at_ms))
                if row.seq <= reset:
                    continue
                if row.kind == "reset":
                    reset = int(row.seq)
                    # A reset that comes after later rows also takes the headers seen before it.
                    known = {
                        url: item if item[5] > reset else (*item[:4], None, -1)
                        for url, item in known.items()
                        if item[0] > reset
                    }
                    continue
                old = known.get(row.url, (-1, 0, row.priority, None, None, -1))
                headers, headers_seq = old[4], old[5]
                if plain(row.headers) is not None and row.seq > headers_seq:
                    headers, headers_seq = row.headers, int(row.seq)
                newest = (int(row.seq), int(row.at_ms), int(row.priority), plain(row.content_type))
                seen = newest if row.seq > old[0] else old[:4]
                known[row.url] = (*seen, headers, headers_seq)
        if not taken:
            return
        ranked = sorted(known.items(), key=lambda item: (-item[1][2], -item[1][1], -item[1][0]))[: self.keep]
        known = dict(ranked)
        for url in before.keys() - known.keys():
            self.urls.removeKey((url,))
        for url, item in known.items():
            if before.get(url) != item:
                self.urls.updateValue((url,), item)
        if reset >= 0:
            self.reset.update((reset,))
        version += 1
        if timer is None and self.lifetime_ms is not None:
            timer = newest_ms + self.lifetime_ms
            self.handle.registerTimer(timer)
        self.seen.update((last, version, newest_ms, timer))
        # Rank 0 carries the number of candidates, so an emptied tab is visible too.
        out = [(*key, last, version, 0, None, None, None, len(ranked), None, False, None)]
        out += [
            (*key, last, version, rank, url, item[3], item[4], item[2], item[1], False, None)
            for rank, (url, item) in enumerate(ranked, start=1)
        ]
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.COLUMNS).astype({"detected_ms": "Int64", "at_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, version, newest_ms, _ = self.seen.get()
        if newest_ms + self.lifetime_ms <= timerValues.getCurrentWatermarkInMs():
            self.seen.clear(), self.reset.clear(), self.urls.clear()
        else:
            self.handle.registerTimer(newest_ms + self.lifetime_ms)
            self.seen.update((last, version, newest_ms, newest_ms + self.lifetime_ms))
        return iter(())

    def close(self) -> None:
        pass


def track_stream_candidates(
    events: DataFrame, keep: int = MAX_CANDIDATES, delay: str = WATERMARK, lifetime_ms: int | None = LIFETIME_MS
) -> DataFrame:
    """Stream form of ``stream_candidates`` and ``rank_stream_candidates``; a silent tab is forgotten."""
    filled = F.size("headers") > 0
    narrow = event_time(
        events,
        delay,
        "tab_id",
        F.col("seq").cast("bigint").alias("seq"),
        "kind",
        "url",
        "content_type",
        F.when(filled, F.to_json("headers")).alias("headers"),
        F.coalesce(media_priority(F.col("url")), F.lit(0)).alias("priority"),
    )
    schema = (
        "tab_id bigint, last_seq bigint, version bigint, rank int, url string, content_type string, "
        "headers string, priority int, detected_ms bigint, late boolean, at_ms bigint"
    )
    return in_event_time(narrow, ["tab_id"], CandidateTracker(keep, lifetime_ms), schema, "Update")


def _advance_task(state: dict, kind: str, stage, progress, details: dict) -> None:
    """One event of a task; the state follows the batch form in ``operators.tasks``."""
    if state["status"] in ("failed", "cancelled") or (
        state["cancel_asked"] and kind in ("update", "completed", "cancel")
    ):
        return
    if kind == "update":
        if state["stage"] != stage:
            state.update(dict.fromkeys(TASK_COUNTERS))
        percent = None if plain(progress) is None else min(100.0, max(0.0, round(progress, 1)))
        state.update(status="running", stage=stage, progress=percent)
        state.update({name: details[name] for name in TASK_COUNTERS if name in details})
    elif kind == "cancel":
        if state["status"] == "completed":
            state["status"] = "running"
        state.update(cancel_asked=True, stage="cancelling", progress=None)
    elif kind == "completed":
        state.update(status="completed", stage="completed", progress=100.0)
    elif kind == "failed":
        state.update(status="failed", stage="error")
    elif kind == "cancelled":
        state.update(dict.fromkeys(TASK_COUNTERS), status="cancelled", stage="cancelled", progress=None)


class Folded(InOrder):
    """One record per key that each row changes in turn.

    The record holds what is final. Batches emit the record with the waiting rows taken
    too, so an answer need not wait for the watermark; a row that comes out of order gives
    a new version.
    """

    START: dict = {}
    PREVIEWS = True

    @classmethod
    def schema(cls, keys: str) -> str:
        return f"{keys}, " + ", ".join(f"{name} {kind}" for name, kind in cls.FIELDS.items()) + ", late boolean, at_ms bigint"

    def advance(self, state: dict, row: dict) -> None:
        raise NotImplementedError

    def _after(self, state: tuple | None, rows: list[tuple]) -> dict:
        now = dict.fromkeys(self.FIELDS) | self.START | {"last_seq": -1, "version": 0}
        if state is not None:
            now = dict(zip(self.FIELDS, state, strict=True))
        for values in rows:
            if values[1] > now["last_seq"]:  # a repeated row counts once
                self.advance(now, dict(zip(self.ROW, values, strict=True)))
                now["last_seq"] = values[1]
        return now

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[*self.KEY, *self.FIELDS, "late", "at_ms"])
        kinds = {"double": "Float64", "bigint": "Int64", "boolean": "boolean"}
        return frame.astype({name: kinds[kind] for name, kind in self.FIELDS.items() if kind in kinds} | {"at_ms": "Int64"})

    def apply(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        return self._values(self._after(state, rows)), []  # shown already while the rows waited

    def _values(self, now: dict) -> tuple:
        return tuple(now[name] for name in self.FIELDS)

    def preview(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        held = self._after(state, [])
        held["version"] += 1
        held = self._values(held)
        return held, [(*key, *self._values(self._after(held, rows)), False, None)]

    def audit(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, *(row[1] if name == "last_seq" else None for name in self.FIELDS), True, row[0]) for row in rows]


class TaskTracker(Folded):
    ROW = (
        {"at_ms": "bigint", "seq": "bigint", "kind": "string", "stage": "string", "progress": "double"}
        | {f"has_{name}": "boolean" for name in TASK_COUNTERS}
        | {name: "double" for name in TASK_COUNTERS}
    )
    FIELDS = (
        {"status": "string", "stage": "string", "progress": "double"}
        | {name: "double" for name in TASK_COUNTERS}
        | {"cancel_asked": "boolean", "last_seq": "bigint", "version": "bigint"}
    )
    KEY = {"task_id": "string"}
    START = {"status": "pending", "stage": "preparing", "cancel_asked": False}

    def advance(self, state: dict, row: dict) -> None:
        details = {name: row[name] for name in TASK_COUNTERS if row[f"has_{name}"]}
        _advance_task(state, row["kind"], row["stage"], row["progress"], details)


def task_state_stream(events: DataFrame, delay: str = WATERMARK, lifetime_ms: int | None = LIFETIME_MS) -> DataFrame:
    """Stream form of ``task_state``."""
    # Rounded by the engine, as in the batch form; Python rounds decimal ties differently.
    rounded = F.bround("progress", 1)
    columns = ["task_id", F.col("seq").cast("bigint").alias("seq"), "kind", "stage", rounded.alias("progress")]
    for name in TASK_COUNTERS:
        has = F.coalesce(F.map_contains_key("details", name), F.lit(False))
        columns += [has.alias(f"has_{name}"), F.try_element_at("details", F.lit(name)).alias(name)]
    rows = event_time(events, delay, *columns)
    return in_event_time(rows, ["task_id"], TaskTracker(lifetime_ms), TaskTracker.schema("task_id string"), "Update")


def _advance_job(state: dict, kind: str, created_at, patch: dict) -> None:
    """One event of a job; a deleted or unknown job ignores patches."""
    if kind == "create":
        state.update(dict.fromkeys(("status", "stage", "progress", "task_id")))
        state.update(alive=True, created_at=created_at, **patch)
    elif kind == "delete":
        state.update(alive=False)  # stays as a tombstone for the key's lifetime
    elif kind == "patch" and state["alive"]:
        if state["stage"] == "cancelling" and patch.get("stage") != "cancelling":
            patch = {"task_id": patch["task_id"]} if not state["task_id"] and patch.get("task_id") else {}
        state.update(patch)


class JobTracker(Folded):
    PATCH = ("status", "stage", "progress", "task_id")
    ROW = (
        {"at_ms": "bigint", "seq": "bigint", "kind": "string", "created_at": "bigint"}
        | {f"has_{name}": "boolean" for name in PATCH}
        | {name: "string" for name in PATCH}
    )
    FIELDS = {"alive": "boolean", "created_at": "bigint"} | {name: "string" for name in PATCH} | {"last_seq": "bigint", "version": "bigint"}
    KEY = {"owner": "string", "job_id": "string"}
    START = {"alive": False}

    def advance(self, state: dict, row: dict) -> None:
        patch = {name: row[name] for name in self.PATCH if row[f"has_{name}"]}
        _advance_job(state, row["kind"], row["created_at"], patch)


def job_state_stream(events: DataFrame, delay: str = WATERMARK, lifetime_ms: int | None = LIFETIME_MS) -> DataFrame:
    """Stream form of ``job_state`` without the retention, which is a batch top-k over the sink."""
    columns = ["owner", "job_id", F.col("seq").cast("bigint").alias("seq"), "kind", F.col("created_at").cast("bigint").alias("created_at")]
    for name in JobTracker.PATCH:
        has = F.coalesce(F.map_contains_key("patch", name), F.lit(False))
        columns += [has.alias(f"has_{name}"), F.try_element_at("patch", F.lit(name)).alias(name)]
    rows = event_time(events, delay, *columns)
    schema = JobTracker.schema("owner string, job_id string")
    return in_event_time(rows, ["owner", "job_id"], JobTracker(lifetime_ms), schema, "Update")


class SubmitTracker(InOrder):
    """The task that a client id got first, by time and sequence number; answers are final."""

    KEY = {"client_request_id": "string"}
    ROW = {"at_ms": "bigint", "seq": "bigint", "task_id": "string"}
    FIELDS = {"first_task_id": "string"}
    COLUMNS = ["client_request_id", "last_seq", "task_id", "effective_task_id", "late", "at_ms"]

    def apply(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        task = rows[0][2] if state is None else state[0]
        return (task,), [(*key, seq, own, task, False, None) for _, seq, own in rows]

    def audit(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, seq, own, None, True, at) for at, seq, own in rows]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.COLUMNS).astype({"at_ms": "Int64"})


def submit_once_stream(requests: DataFrame, delay: str = WATERMARK, lifetime_ms: int | None = LIFETIME_MS) -> DataFrame:
    """Stream form of ``submit_once``: an id's later requests get the task of its first, as long as the id is remembered.

    Requests with an id are answered once the watermark has passed them, so an earlier one
    that comes later still counts as the first; those without are answered at once.
    """
    rows = event_time(requests, delay, F.col("seq").cast("bigint").alias("seq"), "client_request_id", "task_id")
    has_id = F.coalesce("client_request_id", F.lit("")) != ""
    schema = "client_request_id string, last_seq bigint, task_id string, effective_task_id string, late boolean, at_ms bigint"
    named = in_event_time(rows.filter(has_id), ["client_request_id"], SubmitTracker(lifetime_ms), schema, "Append")
    alone = rows.filter(~has_id).select(
        "client_request_id",
        F.col("seq").alias("last_seq"),
        "task_id",
        F.col("task_id").alias("effective_task_id"),
        F.lit(False).alias("late"),
        F.lit(None).cast("bigint").alias("at_ms"),
    )
    return named.unionByName(alone).withColumnRenamed("last_seq", "seq")
