"""Speaker turns: overlap and nearest joins, tiny-cluster merging, numbering, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.operators.ordered import Running, with_running
from segmill.session import checkpointed

# Tolerance of the nearest-turn rule and the limits of the tiny-speaker rule.
NEAREST_MS = 1_000
TINY_MAX_MS = 3_000
TINY_MIN_MS = 1_500
TINY_SHARE = 0.03

# Rows of one recording are swept in chunks of so much time; pairs that touch meet in bins.
CHUNK_MS = 600_000
BIN_MS = 30_000
# Tiny turns look for stable ones so far away by pairs, the others by a sweep.
CLOSE_MS = 5_000

# A segment no longer than NEAR_MS looks for its speaker among the turns of its place, at most so many;
# turns of at most so many places are listed there. All else is swept.
NEAR_MS = 20_000
NEAR_TURNS = 64
NEAR_PLACES = 64


def _bins(low: Column, high: Column, size: int) -> Column:
    return F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))


def _touching(intervals: DataFrame, turns: DataFrame, tolerance: int, bin_ms: int) -> DataFrame:
    """Every pair of an interval ``(rec_id, s0, s1)`` and a turn at most ``tolerance`` apart, once.

    Both sides are placed on time bins, so the join key is ``(rec_id, bin)`` and a
    long recording spreads over many tasks.
    """
    left = intervals.withColumn("_low", F.col("s0") - tolerance).withColumn("_high", F.col("s1") + tolerance)
    left = left.withColumn("bin", F.explode(_bins(F.col("_low"), F.col("_high"), bin_ms)))
    right = turns.withColumn("bin", F.explode(_bins(F.col("t0"), F.col("t1"), bin_ms)))
    first_shared = F.greatest(F.floor(F.col("_low") / bin_ms), F.floor(F.col("t0") / bin_ms))
    return (
        left.join(right, ["rec_id", "bin"])
        .filter((F.col("t0") <= F.col("_high")) & (F.col("t1") >= F.col("_low")))
        .filter(F.col("bin") == first_shared)
        .drop("bin", "_low", "_high")
    )


def _usable_turns(turns: DataFrame) -> DataFrame:
    """Valid turns, equal copies folded into one row with their number."""
    return (
        turns.filter((F.col("end_ms") > F.col("start_ms")) & (F.col("speaker") >= 0))
        .groupBy("rec_id", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "speaker")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _sweep(points: DataFrame, key: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    """Running values over the points of a key in time; ``order`` begins with the time, which may run backwards."""
    return with_running(points, key, order, F.floor(F.col(order[0]) / CHUNK_MS).cast("bigint"), values)


def _overlaps(intervals: DataFrame, turns: DataFrame) -> DataFrame:
    """Per interval ``(rec_id, s0, s1)`` and speaker who is heard in it: ``overlap`` and ``active`` (turns open at its start).

    A speaker's speech up to a time ``x`` is ``x * level - base``, with running sums over the
    starts and ends of the turns before it: the number of open turns and the sum of their
    starts. An interval asks for it at both ends, so the work does not depend on how many
    turns overlap there or how long they are.
    """
    nothing = F.lit(None).cast("bigint")
    marks = F.array(
        F.struct(F.col("t0").alias("x"), F.col("copies").alias("open")), F.struct(F.col("t1").alias("x"), (-F.col("copies")).alias("open"))
    )
    events = turns.select("rec_id", "speaker", F.inline(marks)).select(
        "rec_id", "speaker", "x", F.lit(0).alias("side"), nothing.alias("s0"), nothing.alias("s1"), "open", (F.col("open") * F.col("x")).alias("at")
    )
    speakers = turns.select("rec_id", "speaker").distinct()
    ends = F.array(F.struct(F.col("s0").alias("x"), F.lit(1).alias("side")), F.struct(F.col("s1").alias("x"), F.lit(2).alias("side")))
    asked = intervals.filter("s1 > s0").join(speakers, "rec_id").select("rec_id", "speaker", "s0", "s1", F.inline(ends))
    points = events.unionByName(asked, allowMissingColumns=True)
    sums = {"level": Running("sum", F.coalesce("open", F.lit(0))), "base": Running("sum", F.coalesce("at", F.lit(0)))}
    heard = _sweep(points, ["rec_id", "speaker"], ["x", "side", "s0", "s1"], sums).filter("side > 0")
    until = F.col("x") * F.col("level") - F.col("base")
    return heard.groupBy("rec_id", "s0", "s1", "speaker").agg(
        F.sum(F.when(F.col("side") == 2, until).otherwise(-until)).alias("overlap"),
        F.max(F.when(F.col("side") == 1, F.col("level"))).alias("active"),
    ).filter("overlap > 0")


def _most_heard(intervals: DataFrame, turns: DataFrame) -> DataFrame:
    """``rec_id, s0, s1, speaker``: who overlaps most; of equals the one heard first, then the lowest number."""
    heard = _overlaps(intervals, turns)
    most = F.max("overlap").over(Window.partitionBy("rec_id", "s0", "s1"))
    best = checkpointed(heard.withColumn("most", most).filter("overlap = most").drop("most", "overlap"))
    one = best.groupBy("rec_id", "s0", "s1").agg(F.count(F.lit(1)).alias("n"), F.min("speaker").alias("speaker"))
    # Only equals ask who is heard first: at once, or from the speaker's next start on.
    equals = best.join(one.filter("n > 1").drop("n", "speaker"), ["rec_id", "s0", "s1"])
    silent = equals.filter("active = 0").select("rec_id", "speaker", "s0", "s1", (-F.col("s0")).alias("down"), F.lit(1).alias("side"))
    starts = turns.select("rec_id", "speaker", (-F.col("t0")).alias("down"), F.lit(0).alias("side")).distinct()
    begun = Running("last", F.when(F.col("side") == 0, -F.col("down")))
    points = starts.unionByName(silent, allowMissingColumns=True)
    found = _sweep(points, ["rec_id", "speaker"], ["down", "side", "s0", "s1"], {"first": begun}).filter("side = 1")
    later = found.select("rec_id", "s0", "s1", "speaker", "first")
    firsts = equals.filter("active > 0").select("rec_id", "s0", "s1", "speaker", F.col("s0").alias("first")).unionByName(later)
    chosen = firsts.groupBy("rec_id", "s0", "s1").agg(F.min(F.struct("first", "speaker")).getField("speaker").alias("speaker"))
    return one.filter("n = 1").drop("n").unionByName(chosen)


def _nearest(intervals: DataFrame, turns: DataFrame, tolerance: int) -> DataFrame:
    """``rec_id, s0, s1, speaker, gap``: the closest turn within ``tolerance`` of intervals that no turn overlaps.

    Three turns can be the closest: the last to end before, the next to start after, and for
    an interval without length one that holds it. Of those the earliest start counts: turns
    whose end no earlier start reaches form a staircase, on which it is the next end.
    """
    rec, number = ["rec_id"], F.col("speaker")
    ended = turns.groupBy("rec_id", F.col("t1").alias("x")).agg(F.min(F.struct(F.col("t0"), number)).alias("turn"))
    ended = ended.select("rec_id", "x", F.lit(0).alias("side"), F.struct(F.col("x").alias("t1"), "turn.t0", "turn.speaker").alias("turn"))
    asked = intervals.select("rec_id", "s0", "s1", F.col("s0").alias("x"), F.lit(1).alias("side"))
    left = _sweep(ended.unionByName(asked, allowMissingColumns=True), rec, ["x", "side", "s0", "s1"], {"left": Running("last", F.col("turn"))})
    left = left.filter("side = 1").select("rec_id", "s0", "s1", "left")

    begun = turns.groupBy("rec_id", "t0").agg(F.min(number).alias("speaker"))
    begun = begun.select("rec_id", (-F.col("t0")).alias("down"), F.lit(0).alias("side"), F.struct("t0", "speaker").alias("start"))
    stairs = _sweep(turns, rec, ["t0", "speaker", "t1"], {"reached": Running("max", F.col("t1"), inclusive=False)})
    stairs = stairs.filter(F.col("reached").isNull() | (F.col("t1") > F.col("reached")))
    stairs = stairs.select("rec_id", (-F.col("t1")).alias("down"), F.lit(0).alias("side"), F.struct("t0", "speaker").alias("step"))
    asked = left.select("*", (-F.col("s1")).alias("down"), F.lit(1).alias("side"))
    points = begun.unionByName(stairs, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    nexts = {"right": Running("last", F.col("start")), "hold": Running("last", F.col("step"))}
    around = _sweep(points, rec, ["down", "side", "s0", "s1"], nexts).filter("side = 1")

    def turn(gap: Column, at: str, holds: Column) -> Column:
        return F.when(holds, F.struct(gap.cast("bigint").alias("gap"), F.col(at)["t0"].alias("t0"), F.col(at)["speaker"].alias("speaker")))

    near = F.least(
        turn(F.col("s0") - F.col("left.t1"), "left", F.col("left").isNotNull()),
        turn(F.col("right.t0") - F.col("s1"), "right", F.col("right").isNotNull()),
        turn(F.lit(0), "hold", F.col("hold").isNotNull() & (F.col("hold.t0") <= F.col("s0")) & (F.col("s0") == F.col("s1"))),
    )
    found = around.select("rec_id", "s0", "s1", near.alias("near")).filter(F.col("near.gap") <= tolerance)
    return found.select("rec_id", "s0", "s1", F.col("near.speaker").alias("speaker"), F.col("near.gap").alias("gap"))


def _timed(segments: DataFrame) -> DataFrame:
    timed = segments.drop("speaker").withColumn("s0", F.greatest(F.lit(0), F.col("start_ms")).cast("bigint"))
    return timed.withColumn("s1", F.greatest("s0", "end_ms").cast("bigint"))


def _listed(turns: DataFrame, reach: int) -> DataFrame:
    """``rec_id, place, turns``: all that segments which begin at a place can touch or be ``reach`` from.

    Where these are more than ``NEAR_TURNS``, one more than that is listed.
    """
    first, last = F.floor((F.col("t0") - reach) / NEAR_MS) - 1, F.floor((F.col("t1") + reach) / NEAR_MS)
    placed = turns.filter(F.col("t1") - F.col("t0") <= NEAR_PLACES * NEAR_MS).withColumn("place", F.explode(F.sequence(first, last)))
    order = Window.partitionBy("rec_id", "place").orderBy("t0", "t1", "speaker")
    few = placed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= NEAR_TURNS + 1)
    return few.groupBy("rec_id", "place").agg(F.collect_list(F.struct("t0", "t1", "speaker", "copies")).alias("turns"))


def _from_lists(timed: DataFrame, turns: DataFrame, reach: int) -> DataFrame:
    """Add ``heard``, the speaker who overlaps most, ``near``, the closest turn if none does, and whether the lists told (``told``)."""
    lasting = turns.filter(F.col("t1") - F.col("t0") > NEAR_PLACES * NEAR_MS).select("rec_id").distinct()
    lasting = checkpointed(lasting).withColumn("_lasting", F.lit(True))
    rows = timed.withColumn("place", F.floor(F.col("s0") / NEAR_MS)).join(_listed(turns, reach), ["rec_id", "place"], "left")
    rows = rows.join(lasting, "rec_id", "left").withColumn("_all", F.coalesce("turns", F.array().cast("array<struct<t0:bigint,t1:bigint,speaker:int,copies:bigint>>")))
    told = F.col("_lasting").isNull() & (F.col("s1") - F.col("s0") <= NEAR_MS) & (F.size("_all") <= NEAR_TURNS)

    def shared(t: Column) -> Column:
        begin = F.greatest("s0", t["t0"])
        return F.struct(((F.least("s1", t["t1"]) - begin) * t["copies"]).alias("overlap"), begin.alias("first"), t["speaker"].alias("speaker"))

    def whole(speaker: Column) -> Column:
        own = F.filter("_marks", lambda m: m["speaker"] == speaker)
        total = F.aggregate(own, F.lit(0).cast("bigint"), lambda sum, m: sum + m["overlap"])
        first = F.aggregate(own, F.lit(None).cast("bigint"), lambda least, m: F.least(least, m["first"]))
        return F.struct((-total).alias("less"), first.alias("first"), speaker.alias("speaker"))

    def away(t: Column) -> Column:
        gap = F.greatest(t["t0"] - F.col("s1"), F.col("s0") - t["t1"], F.lit(0)).cast("bigint")
        return F.struct(gap.alias("gap"), t["t0"].alias("t0"), t["speaker"].alias("speaker"))

    met = F.filter("_all", lambda t: (t["t0"] < F.col("s1")) & (t["t1"] > F.col("s0")))
    rows = rows.withColumn("told", told).withColumn("_marks", F.filter(F.transform(met, shared), lambda m: m["overlap"] > 0))
    most = F.array_min(F.transform(F.array_distinct("_marks.speaker"), whole)).getField("speaker")
    heard = F.when(F.size("_marks") == 1, F.get("_marks", F.lit(0))["speaker"]).when(F.size("_marks") > 1, most)
    rows = rows.withColumn("heard", heard).withColumn("near", F.when(F.size("_marks") == 0, F.array_min(F.transform("_all", away))))
    near = F.when(F.col("near.gap") <= reach, F.struct(F.col("near.speaker").alias("speaker"), F.col("near.gap").alias("gap")))
    return rows.withColumn("near", near).drop("place", "turns", "_lasting", "_all", "_marks")


def _matched(segments: DataFrame, turns: DataFrame, tolerance: int) -> DataFrame:
    """The segments with ``heard`` and ``near`` as ``_from_lists`` adds them, swept where the lists do not tell."""
    usable = checkpointed(_usable_turns(turns))
    rows = checkpointed(_from_lists(_timed(segments), usable, tolerance))
    told, rest = rows.filter("told").drop("told"), rows.filter("NOT told").drop("told", "heard", "near")
    if rest.isEmpty():
        return told.drop("s0", "s1")
    key = ["rec_id", "s0", "s1"]
    # Equal intervals are matched once.
    intervals = checkpointed(rest.select(*key).distinct())
    among = usable.join(intervals.select("rec_id").distinct(), "rec_id", "left_semi")
    most = checkpointed(_most_heard(intervals, among))
    near = _nearest(intervals.join(most, key, "left_anti"), among, tolerance)
    found = most.select(*key, F.col("speaker").cast("int").alias("heard")).unionByName(
        near.select(*key, F.struct(F.col("speaker").cast("int").alias("speaker"), F.col("gap").cast("bigint").alias("gap")).alias("near")),
        allowMissingColumns=True,
    )
    return told.unionByName(rest.join(found, key, "left")).drop("s0", "s1")


def assign_speakers(segments: DataFrame, turns: DataFrame, nearest: bool = True, tolerance_ms: int = NEAREST_MS) -> DataFrame:
    """Give each segment the speaker it overlaps most, else (if ``nearest``) the closest turn in tolerance.

    Ties: the earliest overlap, then the lowest number.
    """
    speaker = F.coalesce("heard", "near.speaker") if nearest else F.col("heard")
    return _matched(segments, turns, tolerance_ms).withColumn("speaker", speaker.cast("int")).drop("heard", "near")


def assign_nearest_turn(segments: DataFrame, turns: DataFrame, tolerance_ms: int = NEAREST_MS) -> DataFrame:
    """The closest turn of segments no turn overlaps, with its gap; other segments are left out."""
    near = _matched(segments, turns, tolerance_ms).filter("near IS NOT NULL")
    return near.withColumns({"speaker": F.col("near.speaker"), "gap_ms": F.col("near.gap")}).drop("heard", "near")


def speaker_label(speaker: Column) -> Column:
    return F.when(speaker.isNotNull(), F.concat(F.lit("Спикер "), (speaker + 1).cast("string")))


def renumber_speakers(turns: DataFrame) -> DataFrame:
    """Clamp and filter turns, then number speakers from 0 by first appearance."""
    start = F.greatest(F.lit(0), F.col("start_ms")).cast("bigint")
    valid = turns.withColumn("end_ms", F.greatest(start, F.col("end_ms")))
    valid = valid.withColumn("start_ms", start)
    valid = valid.filter((F.col("end_ms") > F.col("start_ms")) & (F.col("speaker") >= 0))
    appear = valid.groupBy("rec_id", "speaker").agg(F.min(F.struct("start_ms", "end_ms", "speaker")).alias("seen"))
    # One row per speaker of a recording from here.
    order = Window.partitionBy("rec_id").orderBy("seen")
    numbers = appear.select("rec_id", "speaker", (F.row_number().over(order) - 1).cast("int").alias("number"))
    return (
        valid.join(numbers, ["rec_id", "speaker"])
        .withColumn("speaker", F.col("number"))
        .drop("number")
    )


def speaker_stats(turns: DataFrame) -> DataFrame:
    """Speech time and turn count per speaker, with the recording's totals alongside."""
    per_speaker = turns.groupBy("rec_id", "speaker").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count(F.lit(1)).alias("turns")
    )
    # The window sees one row per speaker.
    whole = Window.partitionBy("rec_id")
    return per_speaker.withColumns(
        {
            "speech_seconds": F.bround(F.col("speech_ms") / 1000.0, 2),
            "rec_speakers": F.count(F.lit(1)).over(whole),
            "rec_turns": F.sum("turns").over(whole),
        }
    )


def _nearest_before(tiny: DataFrame, stable: DataFrame, chunk_ms: int, mirror: bool) -> DataFrame:
    """Per tiny turn the closest stable turn that ends before it starts (mirrored: starts after it ends)."""
    near, far = ("t0", "t1") if mirror else ("t1", "t0")
    edge = F.col("s1") if mirror else F.col("s0")
    sign = -1 if mirror else 1
    marks = stable.select(
        "rec_id",
        (F.col(near) * sign).alias("at"),
        F.lit(1).alias("kind"),
        F.struct(
            (F.col(near) * sign).alias("near"),
            (F.col(far) * sign).alias("far"),
            (-F.col("speaker")).alias("low"),
        ).alias("mark"),
        F.lit(None).cast("bigint").alias("s0"),
        F.lit(None).cast("bigint").alias("s1"),
        F.col("speaker").alias("tie"),
        F.col(far).alias("tie_far"),
    )
    asks = tiny.select(
        "rec_id",
        (edge * sign).alias("at"),
        F.lit(0).alias("kind"),
        F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"),
        "s0",
        "s1",
        F.lit(0).alias("tie"),
        F.when(F.lit(mirror), F.col("s0")).otherwise(F.col("s1")).alias("tie_far"),
    )
    rows = with_running(
        marks.unionByName(asks),
        ["rec_id"],
        ["at", "kind", "tie_far", "tie"],
        F.floor(F.col("at") / F.lit(chunk_ms)).cast("bigint"),
        {"found": Running("max", F.col("mark"))},
    ).filter((F.col("kind") == 0) & F.col("found").isNotNull())
    low, high = ("far", "near") if not mirror else ("near", "far")
    return rows.select(
        "rec_id",
        "s0",
        "s1",
        (F.col(f"found.{low}") * sign).alias("t0"),
        (F.col(f"found.{high}") * sign).alias("t1"),
        (-F.col("found.low")).alias("speaker"),
    )


def _closest(candidates: DataFrame) -> DataFrame:
    """``rec_id, s0, s1, new``: the speaker of the nearest candidate, then of the one whose middle is nearest, then of the first."""
    gap = F.greatest(F.col("t0") - F.col("s1"), F.col("s0") - F.col("t1"), F.lit(0))
    apart = F.abs(F.col("t0") + F.col("t1") - F.col("s0") - F.col("s1"))
    best = F.min(F.struct(gap.alias("gap"), apart.alias("apart"), "t0", "t1", "speaker")).getField("speaker")
    return candidates.groupBy("rec_id", "s0", "s1").agg(best.alias("new"))


def collapse_tiny_speakers(
    turns: DataFrame, speaker_count_known: bool = False, bin_ms: int = BIN_MS, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Hand turns of very short speakers to the nearest stable turn, then renumber.

    A tiny turn is paired with the stable ones up to ``CLOSE_MS`` away. Only where there are none, the
    recording is swept for the closest before and the closest after.
    """
    if speaker_count_known:
        return turns
    spoken = turns.groupBy("rec_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken"))
    whole = Window.partitionBy("rec_id")
    least = F.least(F.lit(float(TINY_MAX_MS)), F.greatest(F.lit(float(TINY_MIN_MS)), F.sum("spoken").over(whole) * TINY_SHARE))
    marked = spoken.withColumns({"stable": F.col("spoken") >= least, "speakers": F.count(F.lit(1)).over(whole)})
    marked = marked.withColumn("n_stable", F.sum(F.col("stable").cast("int")).over(whole))
    applies = (F.col("speakers") > 2) & (F.col("n_stable") > 0) & (F.col("n_stable") < F.col("speakers"))
    marked = marked.select("rec_id", "speaker", "stable", applies.alias("applies"))

    # Read by every candidate rule below.
    flagged = checkpointed(turns.join(marked, ["rec_id", "speaker"]))
    is_tiny = F.coalesce(F.col("applies") & ~F.col("stable"), F.lit(False))
    keys = ["rec_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1")]
    tiny = flagged.filter(is_tiny).select(*keys).distinct()
    stable = (
        flagged.filter(F.col("applies") & F.col("stable"))
        .select("rec_id", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "speaker")
        .distinct()
    )
    key = ["rec_id", "s0", "s1"]
    # Three steps below read the result.
    nearest = checkpointed(_closest(_touching(tiny, stable, CLOSE_MS, bin_ms)))
    apart = checkpointed(tiny.join(nearest, key, "left_anti"))
    if not apart.isEmpty():
        among = checkpointed(stable.join(apart.select("rec_id").distinct(), "rec_id", "left_semi"))
        around = (_nearest_before(apart, among, chunk_ms, mirror) for mirror in (False, True))
        nearest = nearest.unionByName(checkpointed(_closest(next(around).unionByName(next(around)))))
    given = nearest.select("rec_id", F.col("s0").alias("start_ms"), F.col("s1").alias("end_ms"), "new")
    changed_turns = flagged.filter(is_tiny).join(given, ["rec_id", "start_ms", "end_ms"], "left")
    merged = flagged.filter(~is_tiny).unionByName(changed_turns.withColumn("speaker", F.col("new")).drop("new"))
    changed = renumber_speakers(merged.filter("applies").drop("stable", "applies"))
    kept = flagged.filter("NOT applies").drop("stable", "applies")
    return changed.unionByName(kept)
