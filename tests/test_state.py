import datetime
import random

from pyspark.sql import functions as F

from segmill.operators import requests as req
from segmill.operators import tasks as tsk
from segmill.streaming import joins, ordered, runs, state

EVENTS = "task_id string, seq bigint, kind string, stage string, progress double, details map<string,double>"
TIMED = EVENTS + ", ts timestamp"
START = datetime.datetime(2024, 1, 1)


def minute(m):
    return START + datetime.timedelta(minutes=m)


def task_rows():
    rng = random.Random(2)
    rows = []
    for task in range(25):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["update"] * 9 + ["cancel", "completed", "failed", "cancelled"])
            details = rng.choice([None, {}, {"downloaded_bytes": float(seq)}, {"downloaded_bytes": None, "eta_seconds": 2.0}])
            rows.append((f"t{task}", seq, kind, rng.choice("ab"), rng.choice([None, -4.0, 3.26, 250.0]), details))
    return rows


def test_task_state_batch_equals_the_step_by_step_rule(spark):
    rows = task_rows()
    want = {}
    for task, _, kind, stage, progress, details in sorted(rows, key=lambda r: (r[0], r[1])):
        held = want.setdefault(task, dict.fromkeys(state.TaskTracker.FIELDS, None) | {"status": "pending", "stage": "preparing", "cancel_asked": False})
        state._advance_task(held, kind, stage, progress, details or {})
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    for r in tsk.task_state(df, chunk_rows=4).collect():
        held = want[r.task_id]
        assert (r.status, r.stage, r.progress, r.downloaded_bytes, r.eta_seconds) == (
            held["status"], held["stage"], held["progress"], held["downloaded_bytes"], held["eta_seconds"]
        ), r.task_id


TASK_COLUMNS = ["task_id", "status", "stage", "progress", "downloaded_bytes", "eta_seconds"]


def turned(rows, late, seed):
    """Rows in order of time with their turn: a third each; some come a turn later, ``late`` of them long after the watermark.

    A turn lasts 9 minutes, so what comes in the next turn is at most 10 minutes behind it.
    """
    rng = random.Random(seed)
    out, lost = [], []
    for row in rows:
        minutes = (row[-1] - START).total_seconds() / 60
        turn = min(2, int(minutes // 9))
        shift = rng.random()
        if turn == 0 and minutes < 4 and shift < late:
            out.append((*row, 2))  # two turns later: the watermark stands at 8 minutes then
            lost.append(row)
        else:
            out.append((*row, min(2, turn + (shift > 0.6 and minutes % 9 > 1))))
    return out, lost


def test_late_rows_within_the_watermark_equal_batch_and_later_ones_are_audited(spark):
    """Three batches, rows up to ten minutes late: states equal the batch form; the rest is in the audit."""
    rows = [(*row, minute(row[1])) for row in task_rows()]
    for late in (0.0, 0.3):
        arrived, lost = turned(rows, late, 4)
        df = spark.createDataFrame(arrived, TIMED + ", turn int").repartition(3)
        out = runs.run_in_turns(df, "turn", 3, state.task_state_stream, "update")
        got = runs._newest(out, "task_id").select(*TASK_COLUMNS).collect()
        kept = [row for row in rows if row not in lost]
        batch = tsk.task_state(spark.createDataFrame(kept, TIMED)).select(*TASK_COLUMNS).collect()
        assert sorted(map(str, got)) == sorted(map(str, batch))
        audit = ordered.late_rows(out, "task_id").collect()
        assert sorted((r.task_id, r.seq) for r in audit) == sorted((row[0], row[1]) for row in lost)
        assert bool(lost) == (late > 0)


def test_jobs_over_late_batches_equal_batch(spark):
    schema = "owner string, job_id string, seq bigint, kind string, created_at bigint, patch map<string,string>, ts timestamp"
    rng, rows = random.Random(9), []
    for seq in range(240):
        kind = rng.choice(["create"] + ["patch"] * 6 + ["delete"])
        fields = {"stage": rng.choice(["new", "work", "cancelling"]), "task_id": f"t{seq}", "status": rng.choice("xy"), "progress": str(seq)}
        patch = {k: x for k, x in fields.items() if rng.random() < 0.4}
        rows.append((f"o{seq % 2}", f"j{rng.randrange(6)}", seq, kind, seq, patch, minute(seq / 10)))
    arrived, lost = turned(rows, 0.0, 6)
    assert not lost
    out = runs.run_in_turns(spark.createDataFrame(arrived, schema + ", turn int"), "turn", 3, state.job_state_stream, "update")
    alive = runs._newest(out, "owner", "job_id").filter("alive")
    columns = ["owner", "job_id", "created_at", *tsk.JOB_FIELDS]
    # the batch form shows an empty task id as missing, and forgets fields of an earlier life of the job
    batch = tsk.job_state(spark.createDataFrame(rows, schema)).select(*columns).collect()
    assert sorted(map(str, alive.select(*columns).collect())) == sorted(map(str, batch)) and len(batch) > 3


def test_a_silent_key_is_forgotten(spark):
    rows = [("t", 1, "update", "a", 1.0, None, minute(0), 0), ("u", 2, "update", "a", 1.0, None, minute(500), 1), ("t", 3, "cancel", "a", None, None, minute(501), 2)]
    df = spark.createDataFrame(rows, TIMED + ", turn int")
    out = runs.run_in_turns(df, "turn", 3, lambda s: state.task_state_stream(s, lifetime_ms=3_600_000), "update")
    got = {r.task_id: (r.stage, r.version) for r in runs._newest(out, "task_id").filter("last_seq <> 1").collect()}
    assert got["t"] == ("cancelling", 1)  # its first version again: nothing of the first life is left


def test_jobs(spark):
    schema = "owner string, job_id string, seq bigint, kind string, created_at bigint, patch map<string,string>"
    rows = [
        ("o", "a", 1, "create", 10, {"stage": "new"}), ("o", "a", 2, "patch", None, {"stage": "cancelling"}),
        ("o", "a", 3, "patch", None, {"stage": "done", "status": "x"}), ("o", "a", 4, "patch", None, {"task_id": "t1", "status": "y"}),
        ("o", "a", 5, "patch", None, {"task_id": "t2"}), ("o", "b", 6, "create", 20, {}), ("o", "b", 7, "delete", None, None),
        ("o", "b", 8, "patch", None, {"stage": "back"}), ("o", "c", 9, "patch", None, {"stage": "never"}),
    ]
    got = tsk.job_state(spark.createDataFrame(rows, schema)).collect()
    assert [(r.job_id, r.stage, r.status, r.task_id) for r in got] == [("a", "cancelling", None, "t1")]


def test_candidates_and_headers(spark):
    schema = "tab_id bigint, seq bigint, kind string, url string, content_type string, headers map<string,string>, ts timestamp"
    rows = [
        (1, 1, "candidate", "https://h/a.mp4", None, {"Cookie": "1"}), (1, 2, "reset", "https://h/", None, None),
        (1, 3, "candidate", "https://h/b.mp4", None, {"Cookie": "2"}), (1, 4, "candidate", "https://h/master.m3u8", None, {}),
        (1, 5, "candidate", "https://h/b.mp4", None, {}),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("ts", F.timestamp_seconds("seq"))
    ranked = req.rank_stream_candidates(req.stream_candidates(df)).orderBy("rank").collect()
    assert [(r.url, r.headers) for r in ranked] == [("https://h/master.m3u8", None), ("https://h/b.mp4", {"Cookie": "2"})]
    hs = spark.createDataFrame(
        [([("COOKIE", "a"), ("x", "y"), ("Origin", "b\nc"), ("cookie", "d" * 20_000)], "p")],
        "headers array<struct<name: string, value: string>>, page_url string",
    )
    assert req.scrub_headers(hs).first().headers == {"Cookie": "a", "Referer": "p"}
    assert req.scrub_headers(hs, on_oversize="reject", add_referer=False).first().headers is None


def test_submit_once(spark):
    rows = [(1, "x", "t1"), (2, "x", "t2"), (3, None, "t3"), (4, None, "t4")]
    df = spark.createDataFrame(rows, "seq bigint, client_request_id string, task_id string")
    assert sorted(r.task_id for r in tsk.accepted_requests(df).collect()) == ["t1", "t3", "t4"]


def test_candidates_over_shuffled_batches_equal_batch(spark):
    schema = "tab_id bigint, seq bigint, kind string, url string, content_type string, headers map<string,string>, ts timestamp"
    rng = random.Random(3)
    rows = []
    for seq in range(120):
        kind = "reset" if rng.random() < 0.05 else "candidate"
        headers = {"Cookie": str(seq)} if rng.random() < 0.5 else {}
        rows.append((seq % 4, seq, kind, f"https://h/{rng.randrange(9)}.mp4", None, headers, minute(seq / 5)))
    columns = ["tab_id", "rank", "url"]
    for late in (0.0, 0.4):
        arrived, lost = turned(rows, late, 11)
        batch = req.rank_stream_candidates(req.stream_candidates(spark.createDataFrame([r for r in rows if r not in lost], schema)))
        out = runs.run_in_turns(spark.createDataFrame(arrived, schema + ", turn int"), "turn", 3, state.track_stream_candidates, "update")
        got = runs._newest(out, "tab_id").filter("rank > 0")
        assert sorted(got.select(*columns, "headers").collect()) == sorted(batch.select(*columns, F.to_json("headers")).collect())
        assert sorted(r.seq for r in ordered.late_rows(out, "tab_id").collect()) == sorted(r[1] for r in lost)


def test_later_submissions_get_the_first_task(spark):
    schema = "seq bigint, client_request_id string, task_id string, ts timestamp"
    rows = [
        (2, "x", "t2", minute(2), 0), (3, None, "t3", minute(3), 0), (1, "x", "t1", minute(1), 1), (4, "x", "t4", minute(9), 1),
        (5, "y", "t5", minute(9), 1), (6, "", "t6", minute(9), 1), (8, None, "end", minute(99), 1), (7, "y", "t7", minute(20), 2),
    ]
    out = runs.run_in_turns(spark.createDataFrame(rows, schema + ", turn int"), "turn", 3, state.submit_once_stream, "append")
    got = {r.seq: r.effective_task_id for r in ordered.settled(out).collect()}
    assert got == {1: "t1", 2: "t1", 3: "t3", 4: "t1", 5: "t5", 6: "t6", 8: "end"}
    assert [r.seq for r in ordered.late_rows(out, "client_request_id").collect()] == [7]


def test_the_last_request_gives_the_headers(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    sent = spark.createDataFrame(
        [("r", at(0), {"Cookie": "1"}), ("r", at(2), {"Cookie": "2"}), ("r", at(6), {"Cookie": "3"}), (None, at(1), {})],
        "request_id string, ts timestamp, headers map<string,string>",
    )
    back = spark.createDataFrame(
        [(1, "r", "video/mp4", at(3)), (2, "r", "video/mp4", at(6)), (3, "r", "video/mp4", at(30)), (4, None, "video/mp4", at(3))],
        "seq bigint, request_id string, content_type string, ts timestamp",
    )
    want = [(1, {"Cookie": "2"}), (2, {"Cookie": "3"}), (3, None), (4, None)]
    joined = req.join_request_response(sent, back)
    assert [(r.seq, r.request_headers) for r in joined.orderBy("seq").collect()] == want


def test_requests_and_responses_in_one_stream_equal_batch(spark):
    """Redirects, completions, equal times, missing ids, rows in any order over three batches: one row a response."""
    rng = random.Random(21)
    sent, back, done = [], [], []
    for k in range(160):
        key, at = rng.choice([*(f"r{j}" for j in range(12)), None]), minute(rng.randrange(0, 1800, 15) / 60)
        what = rng.choice("qqppd")
        if what == "q":
            sent.append((key, at, {"Cookie": str(k)}))
        elif what == "p":
            back.append((k, key, rng.choice(["video/mp4", "text/html"]), at + datetime.timedelta(microseconds=7)))
            back.append((1000 + k, key, "audio/mp4", at))
        else:
            done.append((key, at))
    schemas = ("request_id string, ts timestamp, headers map<string,string>", "seq bigint, request_id string, content_type string, ts timestamp")
    sent, back = spark.createDataFrame(sent, schemas[0]), spark.createDataFrame(back, schemas[1])
    done = spark.createDataFrame([*done, ("", minute(600))], "request_id string, ts timestamp")
    batch = req.join_request_response(sent, back, "7 minutes", done).select("seq", "request_id", "ts", "request_headers").collect()
    parts = [df.select(F.lit(k).alias("part"), F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("row"), "ts") for k, df in enumerate((sent, back, done))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.withColumn("turn", F.when(F.col("ts") > F.lit(minute(300)), 2).otherwise(F.least(F.lit(2), F.floor(F.minute("ts") / 9) + F.abs(F.hash("row")) % 2).cast("int")))

    def operator(stream):
        opened = [
            stream.filter(F.col("part") == k).select(F.from_json("row", told, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r")).select("r.*")
            for k, told in enumerate((*schemas, "request_id string, ts timestamp"))
        ]
        return joins.join_request_response_stream(*opened, within="7 minutes", delay="20 minutes")

    out = runs.run_in_turns(rows, "turn", 3, operator, "append")
    assert ordered.late_rows(out, "request_id").count() == 0
    got = ordered.settled(out).select("seq", "request_id", "ts", "request_headers").collect()
    assert sorted(map(str, got)) == sorted(map(str, batch))
    assert any(r.request_headers for r in got) and any(r.request_headers is None and r.request_id for r in got)
