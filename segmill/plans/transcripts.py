"""The whole way of a transcript as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.operators.captions import dedupe_rolling_captions
from segmill.operators.segments import build_blocks, clean_segments, clip_to_ranges
from segmill.operators.speakers import assign_speakers, collapse_tiny_speakers, renumber_speakers, speaker_label
from segmill.session import checkpointed
from segmill.sources.captions import read_captions


def caption_transcripts(
    files: DataFrame, turns: DataFrame | None = None, ranges: DataFrame | None = None, paragraphize: bool = True
) -> DataFrame:
    """Paragraph blocks from caption files, with speakers if turns are known."""
    # Files are parsed once; the rule below reads the cues twice.
    segments = dedupe_rolling_captions(checkpointed(read_captions(files)))
    if ranges is not None:
        segments = clip_to_ranges(segments, ranges)
    return blocks_of(segments, turns, paragraphize)


def blocks_of(segments: DataFrame, turns: DataFrame | None = None, paragraphize: bool = True) -> DataFrame:
    """Paragraph blocks of any segments."""
    if turns is None:
        labelled = segments.withColumn("speaker", F.lit(None).cast("string"))
    else:
        heard = collapse_tiny_speakers(renumber_speakers(turns))
        labelled = assign_speakers(segments, heard).withColumn("speaker", speaker_label(F.col("speaker")))
    # The block rules read their input more than once; the joins above run once.
    return build_blocks(checkpointed(clean_segments(labelled)), paragraphize)
