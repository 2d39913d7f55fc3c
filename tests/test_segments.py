import random

import pytest
from pyspark.sql import functions as F

from segmill.functions.times import clock
from segmill.operators import segments as seg
from segmill.sinks import transcripts as out

SCHEMA = "rec_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string"


def sequential_blocks(rows):
    """The paragraph rule, one segment after the other."""
    blocks, chars = [], 0
    for r in rows:
        if blocks:
            block, last = blocks[-1], blocks[-1][-1]
            pause = r[2] - last[3]
            longer = chars + len(r[4]) + 1
            if (
                r[5] != last[5] or pause >= 2500 or r[3] - block[0][2] >= 50_000 or longer > 650
                or (chars >= 280 and last[4][-1] in ".!?…" and pause >= 500)
            ):
                blocks.append([r])
                chars = len(r[4])
            else:
                block.append(r)
                chars = longer
        else:
            blocks.append([r])
            chars = len(r[4])
    return blocks


def random_recording(rng, rec, n, calm):
    rows, at = [], 0
    for i in range(n):
        text = "w" * rng.randint(1, 8 if calm else 120) + rng.choice(["", ".", "!"])
        dur = rng.randint(0, 300 if calm else 4000)
        speaker = "a" if calm else rng.choice(["a"] * 9 + ["b"])
        rows.append((rec, i * 2, at, at + dur, text, speaker))
        at += dur + (rng.randint(0, 20) if calm else rng.choice([0, 100, 600, 2500]))
    return rows


def test_blocks_follow_pause_and_speaker(spark):
    rows = [("r", 0, 0, 4000, "Hello.", "a"), ("r", 1, 4200, 8000, "More", "a"), ("r", 2, 12000, 15000, "Later", "a"), ("r", 3, 15100, 16000, "Other", "b")]
    got = seg.build_blocks(spark.createDataFrame(rows, SCHEMA)).orderBy("first_seg").collect()
    assert [(b.first_seg, b.start_ms, b.end_ms, b.text) for b in got] == [
        (0, 0, 8000, "Hello. More"), (2, 12000, 15000, "Later"), (3, 15100, 16000, "Other")
    ]


def test_blocks_equal_the_sequential_rule_in_any_cut(spark):
    rng = random.Random(7)
    recordings = [random_recording(rng, f"r{k}", rng.choice([1, 40, 300]), False) for k in range(12)]
    # One recording without any forced break, longer than many pieces.
    recordings.append(random_recording(rng, "long", 4000, True))
    want = sorted(
        (b[0][0], b[0][1], b[0][2], b[-1][3], " ".join(r[4] for r in b), len(b)) for rows in recordings for b in sequential_blocks(rows)
    )
    rows = [r for rows in recordings for r in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for piece, chunk, parts in ((652, 100, 8), (20_000, 65_536, 1)):
        blocks = seg.build_blocks(df.repartition(parts), piece_rows=piece, chunk_rows=chunk)
        got = sorted((b.rec_id, b.first_seg, b.start_ms, b.end_ms, b.text, b.n_segments) for b in blocks.collect())
        assert got == want


def test_clean_clip_shift(spark):
    rows = [("r", 0, -500, -100, " a \t b\n", None), ("r", 1, 5, 3, "..", None), ("r", 2, 5, 3, "ok!", None), ("r", 3, 0, 1, "  ", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seg_idx: (r.start_ms, r.end_ms, r.text) for r in seg.clean_segments(df).collect()}
    assert got == {0: (0, -100, "a b"), 2: (5, 5, "ok!")}
    assert {r.seg_idx for r in seg.clean_segments(df, remove_short=False).collect()} == {0, 1, 2}
    cues = spark.createDataFrame([("r", 0, 5000, 12000, "x", None), ("r", 1, 12000, 20000, "y", None), ("r", 2, 20000, 25000, "z", None)], SCHEMA)
    assert [(r.start_ms, r.end_ms) for r in seg.clip_time_range(cues, 10_000, 22_000).orderBy("seg_idx").collect()] == [
        (10000, 12000), (12000, 20000), (20000, 22000)
    ]
    assert seg.shift_time(cues, -13_000).orderBy("seg_idx").first()[2:4] == (0, 0)


def test_validate_ranges(spark):
    rows = [(10_000, 90_000, 60_000), (None, 10_000, None), (10_000, None, None), (10_000, 10_200, None), (80_000, 90_000, 60_000), (None, None, 5)]
    df = spark.createDataFrame(rows, "range_start_ms bigint, range_end_ms bigint, duration_ms bigint")
    got = [(r.valid, r.range_end_ms) for r in seg.validate_ranges(df).collect()]
    assert got == [(True, 60_000), (False, 10_000), (False, None), (False, 10_200), (False, 90_000), (True, None)]


def test_documents(spark):
    row = spark.range(1).select(clock(F.lit(95_250)).alias("a"), clock(F.lit(95_250), ",").alias("b")).first()
    assert tuple(row) == ("00:01:35", "00:01:35,250")
    segs = spark.createDataFrame([("r", 3, 0, 1500, "One", "A"), ("r", 7, 1500, 2000, "Two", None)], SCHEMA)
    recs = spark.createDataFrame([("r", "T  x", "u", None, "00:02", "ru", "m", "L")], "rec_id string, title string, source_url string, author string, duration_text string, language string, model string, source_label string")
    recs = recs.withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    units = out.transcript_units(segs, seg.build_blocks(segs, paragraphize=False), recs)
    for size in (1, 20_000):
        parts = out.document_parts(units, size).orderBy("format", "part").collect()
        docs = {}
        for p in parts:
            docs[p.format] = docs.get(p.format, "") + p.content
        assert docs["srt"] == "1\n00:00:00,000 --> 00:00:01,500\nA: One\n\n2\n00:00:01,500 --> 00:00:02,000\nTwo\n"
        assert docs["vtt"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nA: One\n\n00:00:01.500 --> 00:00:02.000\nTwo\n"
        assert docs["txt"] == "[00:00:00]\nA: One\n\n[00:00:01]\nTwo\n"
        assert docs["md"].startswith("# T x\n\n- L: u\n- Автор: Не указан\n") and docs["md"].endswith("### 00:00:00\n\n**A:** One\n\n### 00:00:01\n\nTwo\n")


def test_written_files_equal_documents(spark, tmp_path):
    segs = spark.createDataFrame([("r", i, i * 1000, i * 1000 + 900, f"t{i}", None) for i in range(50)], SCHEMA)
    recs = spark.createDataFrame([("r",)], "rec_id string")
    units = out.vtt_units(segs, recs)
    path = str(tmp_path / "out")
    out.write_transcripts(units, path, units_per_part=20)
    names = ["r.part00001.vtt", "r.part00002.vtt", "r.vtt"]
    files = {f.name: f for f in (tmp_path / "out").glob("part-*/*.vtt")}
    assert sorted(files) == names
    text = "".join(files[name].read_text() for name in (names[2], *names[:2]))
    assert text == out.document_parts(units).first().content
    with pytest.raises(FileExistsError):
        out.write_transcripts(units, path)
    assert not list((tmp_path / "out").glob("_attempts*"))


def test_written_files_read_back(spark, tmp_path):
    ids = ["", "a/b.c_d+e*~%", "é \U0001d4b3", "r.part00001", "-"]
    units = spark.createDataFrame([(k, f, u, f"{k}é{u}") for k in ids for f in ("md", "txt") for u in range(3)], "rec_id string, format string, unit long, text string")
    out.write_transcripts(units, str(tmp_path / "out"), units_per_part=2)
    rows = lambda df: sorted(map(tuple, df.select("rec_id", "format", "part", "content").collect()))
    assert rows(out.read_transcripts(spark, str(tmp_path / "out"))) == rows(out.document_parts(units, 2))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from segmill.sinks.files import write_files

    rows = spark.range(0, 40, 1, 4).selectExpr("CAST(id AS STRING) AS name", "IF(id = 39, raise_error('broken'), 'x') AS content")
    with pytest.raises(Exception, match="broken"):
        write_files(rows, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("part-*")) and not (tmp_path / "out" / "_SUCCESS").exists()


def test_the_driver_lists_folders_not_files(spark, tmp_path):
    from segmill.sinks.files import read_files, write_files

    place = str(tmp_path / "out")
    for job in range(2):
        rows = spark.range(40 * job, 40 * job + 40, 1, 3).selectExpr("CAST(id AS STRING) || '.txt' AS name", "repeat('é\\r\\n', CAST(id AS INT)) AS content")
        write_files(rows, place, "append")
    (tmp_path / "out" / "_attempts-x" / "part-0").mkdir(parents=True)
    (tmp_path / "out" / "_attempts-x" / "part-0" / "torn.txt").write_text("torn")
    read = read_files(spark, place)
    assert read.inputFiles() == [] and read.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, read.collect())) == sorted((f"{k}.txt", "é\r\n" * k) for k in range(80))
    write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path / "none"))
    assert read_files(spark, str(tmp_path / "none")).count() == 0
