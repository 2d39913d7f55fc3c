"""Cleaning, clipping and shifting of segments, range checks, and paragraph blocks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions.text import collapse_spaces, has_alnum, strip
from segmill.operators.ordered import CHUNK_ROWS, Running, position_chunk, with_running
from segmill.session import checkpointed

# The paragraph rules.
LONG_PAUSE_MS = 2_500
LONG_BLOCK_MS = 50_000
FULL_BLOCK_CHARS = 650
NATURAL_BLOCK_CHARS = 280
NATURAL_PAUSE_MS = 500
SENTENCE_ENDS = (".", "!", "?", "…")

# Fixed value: the shortest usable time range.
MIN_RANGE_MS = 500

# A block of more than one segment has at most 650 characters, each later segment
# adds at least its joining space, so a block never has more segments than this.
MAX_BLOCK_SEGMENTS = FULL_BLOCK_CHARS + 2


def clean_segments(df: DataFrame, remove_short: bool = True) -> DataFrame:
    """Collapse white space, drop empty (and, if asked, 1-2 character symbol-only) texts, clamp times."""
    raw = F.col("text")
    # Judged by the raw text where that is enough, which for nearly every row is its first letter.
    kept = has_alnum(raw) | (F.length(collapse_spaces(raw)) > 2) if remove_short else strip(raw) != ""
    return df.filter(kept).withColumns(
        {
            "text": collapse_spaces(raw),
            "end_ms": F.greatest("start_ms", "end_ms"),
            "start_ms": F.greatest(F.lit(0), F.col("start_ms")).cast("bigint"),
        }
    )


def clip_time_range(
    df: DataFrame, start_ms: Column | int | None = None, end_ms: Column | int | None = None
) -> DataFrame:
    """Keep what overlaps ``[start, end)``; edges are cut, times stay absolute.

    Limits are literals (pushed to the scan) or columns of ``df``.
    """
    start, end = F.col("start_ms"), F.col("end_ms")
    low = F.greatest(F.lit(0), F.coalesce(_as_column(start_ms), F.lit(0))).cast("bigint")
    if start_ms is None or isinstance(start_ms, int):
        low = F.lit(max(0, start_ms or 0)).cast("bigint")
    kept = df.filter(end > low)
    new_end = end
    if end_ms is not None:
        high = _as_column(end_ms).cast("bigint")
        kept = kept.filter(high.isNull() | (start < high))
        new_end = F.least(end, high)
    return kept.withColumns({"start_ms": F.greatest(start, low), "end_ms": new_end}).filter(
        F.col("end_ms") > F.col("start_ms")
    )


def _as_column(value: Column | int | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clip_to_ranges(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per-recording limits from ``ranges(rec_id, range_start_ms, range_end_ms)``; others pass whole."""
    limited = df.join(ranges.select("rec_id", "range_start_ms", "range_end_ms"), "rec_id", "left")
    clipped = clip_time_range(limited, F.col("range_start_ms"), F.col("range_end_ms"))
    return clipped.drop("range_start_ms", "range_end_ms")


def shift_time(df: DataFrame, offset_ms: Column | int) -> DataFrame:
    """Move segments by an offset; start stays at or above 0 and end at or above start."""
    offset = _as_column(offset_ms)
    start = F.greatest(F.lit(0), F.col("start_ms") + offset).cast("bigint")
    return df.withColumns(
        {"start_ms": start, "end_ms": F.greatest(start, F.col("end_ms") + offset).cast("bigint")}
    )


def validate_ranges(df: DataFrame) -> DataFrame:
    """Check ``range_start_ms, range_end_ms`` against ``duration_ms``; bad rows get a reason, none is dropped."""
    start, end, duration = F.col("range_start_ms"), F.col("range_end_ms"), F.col("duration_ms")
    known = F.coalesce(duration > 0, F.lit(False))
    clamped = F.when(known & end.isNotNull(), F.least(end, duration)).otherwise(end)
    reason = (
        F.when(start.isNull() & end.isNull(), F.lit(None).cast("string"))
        .when(start.isNull() | end.isNull(), F.lit("incomplete"))
        .when((start < 0) | (end - start < MIN_RANGE_MS), F.lit("invalid"))
        .when(known & (start >= duration), F.lit("after_end"))
        .when(clamped - start < MIN_RANGE_MS, F.lit("too_short"))
    )
    return df.withColumns(
        {
            "reason": reason,
            "valid": reason.isNull(),
            "range_end_ms": F.when(reason.isNull(), clamped).otherwise(end),
        }
    )


# --- paragraph blocks -------------------------------------------------------------


def block_input(segments: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Segments with their dense position and the breaks that need only the previous row."""
    previous = F.struct("end_ms", "speaker")
    numbered = with_running(
        segments.select("rec_id", "seg_idx", "start_ms", "end_ms", "text", "speaker"),
        ["rec_id"],
        ["seg_idx"],
        position_chunk("seg_idx", chunk_rows),
        {"pos": Running("sum", F.lit(1), inclusive=False), "prev": Running("last", previous, inclusive=False)},
        dense=True,
    )
    pause = F.col("start_ms") - F.col("prev.end_ms")
    forced = (
        F.col("prev").isNull()
        | ~F.col("speaker").eqNullSafe(F.col("prev.speaker"))
        | (pause >= LONG_PAUSE_MS)
    )
    return numbered.select(
        "rec_id",
        F.col("pos").cast("bigint").alias("pos"),
        "seg_idx",
        "start_ms",
        "end_ms",
        "text",
        "speaker",
        F.length("text").alias("n_chars"),
        forced.alias("forced"),
        (pause >= NATURAL_PAUSE_MS).alias("breath"),
        F.substring("text", -1, 1).isin(*SENTENCE_ENDS).alias("closes"),
    )


def _next_start(rows: dict, first: int, stop: int) -> int:
    """The row after ``first`` at which the next block starts, or ``stop``."""
    begin, chars = rows["start_ms"][first], rows["n_chars"][first]
    row = first + 1
    while row < stop:
        longer = chars + rows["n_chars"][row] + 1
        if (
            rows["forced"][row]
            or rows["end_ms"][row] - begin >= LONG_BLOCK_MS
            or longer > FULL_BLOCK_CHARS
            or (chars >= NATURAL_BLOCK_CHARS and rows["closes"][row - 1] and rows["breath"][row])
        ):
            break
        chars = longer
        row += 1
    return row


_NUMBERS = ["start_ms", "end_ms", "n_chars", "forced", "breath", "closes"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole ``(rec_id, piece)`` groups of a sorted partition; a piece has a bounded row count."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        pending.append(batch)
        table = pa.Table.from_batches(pending)
        last = (table["rec_id"][-1], table["piece"][-1])
        cut = table.num_rows
        recs, pieces = table["rec_id"], table["piece"]
        while cut and (recs[cut - 1], pieces[cut - 1]) == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        pending = table.slice(cut).combine_chunks().to_batches()
    if pending:
        yield pa.Table.from_batches(pending)


def _group_edges(table: pa.Table) -> list[int]:
    recs, pieces = table["rec_id"].to_pylist(), table["piece"].to_pylist()
    edges = [0]
    edges += [i for i in range(1, len(recs)) if recs[i] != recs[i - 1] or pieces[i] != pieces[i - 1]]
    return [*edges, len(recs)]


def _exit_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each possible entry row of a piece, the entry row it leads to in the next piece."""
    for table in _groups(batches):
        rows = {c: table[c].to_pylist() for c in _NUMBERS}
        own = table["own"].to_pylist()
        edges = _group_edges(table)
        out = defaultdict(list)
        for low, high in zip(edges, edges[1:]):
            body = low + sum(own[low:high])
            exits: dict[int, int] = {}
            for entry in range(low, min(body, low + MAX_BLOCK_SEGMENTS)):
                trail, row = [], entry
                while row < body and row not in exits:
                    trail.append(row)
                    row = _next_start(rows, row, high)
                leave = exits.get(row, row - body)
                exits.update(dict.fromkeys(trail, leave))
            out["rec_id"].append(table["rec_id"][low].as_py())
            out["piece"].append(table["piece"][low].as_py())
            out["exits"].append([exits[r] for r in range(low, min(body, low + MAX_BLOCK_SEGMENTS))])
        yield pa.RecordBatch.from_pydict(
            dict(out),
            schema=pa.schema(
                [("rec_id", pa.string()), ("piece", pa.int64()), ("exits", pa.list_(pa.int32()))]
            ),
        )


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches):
        rows = {c: table[c].to_pylist() for c in [*_NUMBERS, "rec_id", "seg_idx", "text", "speaker", "entry", "own"]}
        edges = _group_edges(table)
        out = defaultdict(list)
        for low, high in zip(edges, edges[1:]):
            body = low + sum(rows["own"][low:high])
            row = low + rows["entry"][low]
            while row < body:
                stop = _next_start(rows, row, high)
                out["rec_id"].append(rows["rec_id"][row])
                out["first_seg"].append(rows["seg_idx"][row])
                out["start_ms"].append(rows["start_ms"][row])
                out["end_ms"].append(rows["end_ms"][stop - 1])
                out["text"].append(" ".join(rows["text"][row:stop]))
                out["speaker"].append(rows["speaker"][row])
                out["n_segments"].append(stop - row)
                row = stop
        if out:
            speaker_type = table.schema.field("speaker").type
            yield pa.RecordBatch.from_pydict(
                dict(out),
                schema=pa.schema(
                    [("rec_id", pa.string()), ("first_seg", pa.int32()), ("start_ms", pa.int64()),
                     ("end_ms", pa.int64()), ("text", pa.string()), ("speaker", speaker_type),
                     ("n_segments", pa.int32())]
                ),
            )


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Cut recordings into pieces; the head of each piece also rides along with the piece before it."""
    piece = F.floor(F.col("pos") / F.lit(piece_rows)).cast("bigint")
    ahead = (F.col("pos") % piece_rows < MAX_BLOCK_SEGMENTS) & (piece > 0)
    owners = F.when(ahead, F.array(piece, piece - 1)).otherwise(F.array(piece))
    return rows.withColumn("piece", F.explode(owners)).withColumn("own", (piece == F.col("piece")).cast("int"))


def _sorted_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("rec_id", "piece").sortWithinPartitions("rec_id", "piece", "pos")


def _piece_entries(pieces: DataFrame) -> DataFrame:
    """The true entry row of every piece after a recording's first one.

    Following ``entry -> exits[entry]`` from piece to piece needs one small row per
    piece, never the segments themselves.
    """
    schema = "rec_id string, piece bigint, exits array<int>"
    tables = _sorted_pieces(pieces.drop("text", "speaker")).mapInArrow(_exit_tables, schema)
    # A piece whose exits agree starts a new chain: what came before it no longer matters.
    settled = F.size(F.array_distinct("exits")) == 1
    tables = tables.withColumn("exits", F.when(settled, F.slice("exits", 1, 1)).otherwise(F.col("exits")))
    earlier = Window.partitionBy("rec_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    chains = tables.withColumn("chain", F.sum((F.size("exits") == 1).cast("int")).over(earlier))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "exits")))
    path = F.aggregate(
        "steps",
        F.array(F.lit(0)),
        lambda entries, item: F.concat(
            entries,
            F.array(F.coalesce(F.get(item["exits"], F.element_at(entries, -1)), F.get(item["exits"], F.lit(0)))),
        ),
    )
    return (
        chains.groupBy("rec_id", "chain")
        .agg(ordered.alias("steps"))
        .select("rec_id", F.col("steps")[0]["piece"].alias("first_piece"), F.posexplode(path).alias("hop", "entry"))
        .filter(F.col("hop") > 0)
        .select("rec_id", (F.col("first_piece") + F.col("hop")).cast("bigint").alias("piece"), "entry")
    )


def build_blocks(
    segments: DataFrame,
    paragraphize: bool = True,
    piece_rows: int = 16_384,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Group the segments of a recording into paragraph blocks, keyed by their first segment.

    A block decision looks at most ``MAX_BLOCK_SEGMENTS`` rows ahead, so recordings
    are cut into pieces of bounded size and a long one is folded by many tasks.
    """
    if not paragraphize:
        return segments.select(
            "rec_id",
            F.col("seg_idx").alias("first_seg"),
            "start_ms",
            "end_ms",
            "text",
            "speaker",
            F.lit(1).alias("n_segments"),
        )
    if piece_rows < MAX_BLOCK_SEGMENTS:
        raise ValueError(f"piece_rows must be at least {MAX_BLOCK_SEGMENTS}")
    # Written once: the first pass reads the numbers of cut recordings, the second everything.
    pieces = checkpointed(_pieces(block_input(segments, chunk_rows), piece_rows))
    cut = pieces.filter("piece > 0").select("rec_id").distinct()
    entries = _piece_entries(pieces.join(cut, "rec_id", "left_semi"))
    ready = pieces.join(entries, ["rec_id", "piece"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    speaker = segments.schema["speaker"].dataType.simpleString()
    schema = (
        "rec_id string, first_seg int, start_ms bigint, end_ms bigint, text string, "
        f"speaker {speaker}, n_segments int"
    )
    return _sorted_pieces(ready).mapInArrow(_emit_blocks, schema)


def number_blocks(blocks: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the 0-based ``block_idx`` inside the recording."""
    return with_running(
        blocks,
        ["rec_id"],
        ["first_seg"],
        position_chunk("first_seg", chunk_rows),
        {"block_idx": Running("sum", F.lit(1), inclusive=False)},
        dense=True,
    ).withColumn("block_idx", F.col("block_idx").cast("int"))
