"""Speakers of segments against all pairs of segment and turn."""

import random

import pytest

from segmill.operators import speakers as spk

SEGMENTS = "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string"
TURNS = "rec_id string, start_ms bigint, end_ms bigint, speaker int"


def expected(segments, turns, nearest=True, tolerance=1000):
    out = {}
    by_rec = {}
    for rec, a, b, who in turns:
        if b > a and who >= 0:
            by_rec.setdefault(rec, []).append((a, b, who))
    for rec, idx, start, end, _ in segments:
        s0 = max(0, start)
        s1 = max(s0, end)
        heard, near = {}, []
        for a, b, who in by_rec.get(rec, ()):
            shared = min(s1, b) - max(s0, a)
            if shared > 0:
                total, first = heard.get(who, (0, 1 << 60))
                heard[who] = (total + shared, min(first, max(s0, a)))
            near.append((max(a - s1, s0 - b, 0), a, who))
        if heard:
            out[rec, idx] = (min((-t, f, w) for w, (t, f) in heard.items())[2], None)
        elif nearest and near and min(near)[0] <= tolerance:
            out[rec, idx] = (min(near)[2], min(near)[0])
        else:
            out[rec, idx] = (None, None)
    return out


def check(spark, segments, turns, **options):
    seg = spark.createDataFrame(segments, SEGMENTS).repartition(3)
    trn = spark.createDataFrame(turns, TURNS).repartition(3)
    want = expected(segments, turns, **options)
    got = {(r.rec_id, r.seg_idx): r.speaker for r in spk.assign_speakers(seg, trn, nearest=options.get("nearest", True)).collect()}
    assert got == {k: who for k, (who, _) in want.items()}
    if options.get("nearest", True):
        near = {(r.rec_id, r.seg_idx): (r.speaker, r.gap_ms) for r in spk.assign_nearest_turn(seg, trn).collect()}
        assert near == {k: v for k, v in want.items() if v[1] is not None}
    return got


@pytest.mark.parametrize("chunk", [600_000, 700])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(spk, "CHUNK_MS", chunk)
    rng = random.Random(chunk)
    segments, turns = [], []
    for rec in "abcd":
        for k in range(60):
            at = rng.randrange(0, 12_000, 50)
            segments.append((rec, k, at - 100, at + rng.choice([-50, 0, 100, 100, 350, 2000]), "x"))
        for _ in range(rng.choice([0, 6, 40])):
            at = rng.randrange(0, 14_000, 50)
            turns.append((rec, at, at + rng.choice([-100, 0, 50, 100, 500, 4000]), rng.randrange(-1, 5)))
    turns += turns[::5]  # repeated turns count twice
    check(spark, segments, turns)
    check(spark, segments, turns, nearest=False)


def test_crosstalk_and_a_day_long_turn(spark):
    """5,000 turns of many speakers at one time, and one turn of 24 hours, which stays two points."""
    rng = random.Random(8)
    turns = [("r", at, at + rng.randrange(1, 30_000), rng.randrange(40)) for at in (rng.randrange(30_000) for _ in range(5000))]
    turns.append(("r", 0, 86_400_000, 77))
    segments = [("r", k, at, at + 400, "x") for k, at in enumerate(range(0, 60_000, 200))] + [("r", 999, 80_000_000, 80_000_100, "x")]
    got = check(spark, segments, turns, nearest=False)
    assert got["r", 999] == 77
    usable = spk._usable_turns(spark.createDataFrame(turns, TURNS))
    intervals = spark.createDataFrame([("r", s, e) for _, _, s, e, _ in segments], "rec_id string, s0 bigint, s1 bigint")
    swept = spk._overlaps(intervals, usable)
    assert swept.count() <= len(segments) * 41


@pytest.mark.parametrize("limits", [{}, {"NEAR_TURNS": 3}, {"NEAR_MS": 300}, {"NEAR_MS": 300, "NEAR_PLACES": 2}])
def test_lists_and_sweep_agree(spark, monkeypatch, limits):
    """Long intervals, crowded places and lasting turns are swept, the rest is told by the turns of its place."""
    for name, value in limits.items():
        monkeypatch.setattr(spk, name, value)
    rng = random.Random(len(limits))
    segments, turns = [], []
    for rec in "abc":
        for k in range(80):
            at = rng.randrange(0, 9_000, 50)
            segments.append((rec, k, at - 100, at + rng.choice([-50, 0, 100, 299, 300, 301, 2000]), "x"))
        for _ in range(rng.choice([5, 40])):
            at = rng.randrange(-2_000, 11_000, 50)
            turns.append((rec, at, at + rng.choice([0, 50, 100, 400, 4000 if rec == "c" else 300]), rng.randrange(-1, 4)))
    segments.append(("none", 0, 0, 100, "x"))
    check(spark, segments, turns + turns[::4])
    check(spark, segments, turns, nearest=False)


def test_sparse_turns_make_no_row_per_speaker(spark):
    """30 speakers in turn: a segment is not asked about those who are far away."""
    turns = [("r", k * 1000, k * 1000 + 900, k % 30) for k in range(600)]
    segments = [("r", k, k * 500, k * 500 + 400, "x") for k in range(1200)]
    seg = spark.createDataFrame(segments, SEGMENTS)
    trn = spark.createDataFrame(turns, TURNS)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = written()
    got = {r.seg_idx: r.speaker for r in spk.assign_speakers(seg, trn).collect()}
    assert written() - before < 10 * len(segments)
    assert got == {k: k // 2 % 30 for k in range(1200)}


@pytest.mark.parametrize("close", [5_000, 300, 0])
def test_tiny_turns_near_and_far(spark, monkeypatch, close):
    """By pairs, by the sweep, or both: the nearest stable turn of all."""
    monkeypatch.setattr(spk, "CLOSE_MS", close)
    rng, turns = random.Random(5), []
    for rec in "ab":
        for _ in range(12):
            at = rng.randrange(0, 60_000, 100)
            turns.append((rec, at, at + rng.choice([2000, 3000, 3000]), rng.randrange(2)))
        for k in range(10):
            at = rng.randrange(-1_000, 70_000, 100)
            turns.append((rec, at, at + rng.choice([100, 200, 1000 if rec == "b" else 100]), 2 + k))
    turns += turns[::5]
    want = []
    for rec in "ab":
        rows = [t for t in turns if t[0] == rec]
        spoken = {w: sum(e - s for _, s, e, x in rows if x == w) for w in {t[3] for t in rows}}
        least = min(3000.0, max(1500.0, sum(spoken.values()) * 0.03))
        stable = [t for t in rows if spoken[t[3]] >= least]
        assert 0 < len({t[3] for t in stable}) < len(spoken)
        for _, s, e, who in rows:
            if spoken[who] < least:
                who = min((max(a - e, s - b, 0), abs(a + b - s - e), a, b, w) for _, a, b, w in stable)[4]
            want.append((rec, s, e, who))
    want = spk.renumber_speakers(spark.createDataFrame(want, TURNS)).select("rec_id", "start_ms", "end_ms", "speaker").collect()
    df = spark.createDataFrame(turns, TURNS)
    got = spk.collapse_tiny_speakers(df, chunk_ms=7_000).select("rec_id", "start_ms", "end_ms", "speaker").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    if close == 5_000:
        plan = spk.collapse_tiny_speakers(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan  # the nearest are made once, before
