"""Requests and responses matched in one keyed state over the union of their streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.operators.requests import is_media_type
from segmill.streaming.ordered import WATERMARK, InOrder, event_time, in_event_time

#: Order of rows at one time: requests first, then responses, then what ends the request.
_REQUEST, _RESPONSE, _DONE = range(3)
_MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class RequestMatcher(InOrder):
    """The last request of an id, until its completion or until it is too old; each response takes its headers."""

    KEY = {"request_id": "string"}
    ROW = {"at_ms": "bigint", "at_us": "bigint", "turn": "int", "seq": "bigint", "headers": "string", "body": "string"}
    FIELDS = {"at_us": "bigint", "headers": "string"}
    COLUMNS = ["request_id", "seq", "body", "request_headers", "late", "at_ms"]

    def __init__(self, within: pd.Timedelta):
        super().__init__(int(within / pd.Timedelta(milliseconds=1)))
        self.within_us = int(within / pd.Timedelta(microseconds=1))

    def apply(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        sent, out = state, []
        # Of requests at one time the one whose headers are last as text counts.
        for _, at, turn, seq, headers, body in sorted(rows, key=lambda row: (row[1], row[2], row[4] or "")):
            if turn == _REQUEST:
                sent = (at, headers)
            elif turn == _DONE:
                sent = None
            else:
                known = sent is not None and at <= sent[0] + self.within_us
                out.append((*key, seq, body, sent[1] if known else None, False, None))
        return sent, out

    def audit(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, seq, body, None, True, at) for at, _, _, seq, _, body in rows]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.COLUMNS).astype({"seq": "Int64", "at_ms": "Int64"})


def join_request_response_stream(
    requests: DataFrame, responses: DataFrame, completions: DataFrame | None = None, within: str = WATERMARK, delay: str = WATERMARK
) -> DataFrame:
    """One row per media response, with the headers of its id's last request; stream form of ``join_request_response``.

    ``completions`` (``request_id, ts``) end a request. The three streams are one keyed
    state under one watermark: rows wait until it has passed them, a request is released by
    its completion or once it is older than ``within``. Responses without an id have no
    request and go out at once. Audit rows of whatever kind have ``late`` set.
    """
    rest = [c for c in responses.columns if c not in ("request_id", "ts")]
    media = responses.filter(is_media_type(F.col("content_type")))

    def part(df: DataFrame, turn: int, headers, body) -> DataFrame:
        seq = F.col("seq").cast("bigint") if "seq" in df.columns else F.lit(None).cast("bigint")
        return df.select("request_id", "ts", F.lit(turn).alias("turn"), seq.alias("seq"), headers.alias("headers"), body.alias("body"))

    nothing = F.lit(None).cast("string")
    body = F.to_json(F.struct(*rest, F.col("ts")), _MICROSECONDS)
    rows = part(requests, _REQUEST, F.to_json("headers"), nothing).unionByName(part(media, _RESPONSE, nothing, body))
    if completions is not None:
        rows = rows.unionByName(part(completions, _DONE, nothing, nothing))
    rows = event_time(rows, delay, "request_id", F.unix_micros("ts").alias("at_us"), "turn", "seq", "headers", "body")
    schema = "request_id string, seq bigint, body string, request_headers string, late boolean, at_ms bigint"
    matcher = RequestMatcher(pd.Timedelta(within))
    matched = in_event_time(rows.filter("request_id IS NOT NULL"), ["request_id"], matcher, schema, "Append")
    alone = rows.filter(f"request_id IS NULL AND turn = {_RESPONSE}").select(
        "request_id", "seq", "body", nothing.alias("request_headers"), F.lit(False).alias("late"), F.lit(None).cast("bigint").alias("at_ms")
    )
    told = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in [*rest, "ts"])
    kind = requests.schema["headers"].dataType.simpleString()
    opened = matched.unionByName(alone).withColumn("body", F.from_json("body", told, _MICROSECONDS))
    return opened.select("request_id", *(F.col("body")[c].alias(c) for c in [*rest, "ts"]), F.from_json("request_headers", kind).alias("request_headers"), "late", "at_ms")
