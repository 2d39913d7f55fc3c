"""Job progress in batch form: task and job state from event logs, progress, batch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.operators.ordered import CHUNK_ROWS, Running, position_chunk, with_running
from segmill.schemas import TASK_COUNTERS

# Retention and the smallest share that gives an estimate.
MAX_JOBS = 10
MIN_ETA_SHARE = 0.01


def progress_and_eta(events: DataFrame) -> DataFrame:
    """Percent done and seconds left per event of ``(task_id, stage, ts_ms, done, total)``."""
    first = events.groupBy("task_id", "stage").agg(F.min("ts_ms").alias("started_ms"))
    share = F.least(F.lit(1.0), F.col("done") / F.col("total"))
    known = F.col("total") > 0
    elapsed = (F.col("ts_ms") - F.col("started_ms")) / 1000.0
    return events.join(first, ["task_id", "stage"]).withColumns(
        {
            "percent": F.when(known, share * 100),
            "eta_seconds": F.when(known & (share >= MIN_ETA_SHARE), elapsed * (1 - share) / share),
        }
    )


def batch_percent(position: Column, nested: Column, total: Column) -> Column:
    """Overall percent of a batch at its ``position``-th item (1-based)."""
    inner = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(nested, F.lit(0.0))))
    return ((position - 1) + inner / 100) / total * 100


def batch_outcome(items: DataFrame) -> DataFrame:
    """Outcome per batch of ``items(batch_id, item, outputs, error)``.

    The error list is kept beside the outcome as rows (see ``batch_errors``), so a
    batch with very many errors never becomes one array.
    """
    grouped = items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.coalesce("outputs", F.lit(0))).alias("outputs"),
    )
    return grouped.select(
        "batch_id",
        "total",
        "errors",
        (F.col("total") - F.col("errors")).alias("completed"),
        F.when(F.col("outputs") > 0, "completed").otherwise("failed").alias("status"),
    )


def batch_errors(items: DataFrame) -> DataFrame:
    return items.filter(F.col("error").isNotNull()).select("batch_id", "item", "error")


def submit_once(requests: DataFrame) -> DataFrame:
    """All requests with the task their client id got first; requests without an id each get their own.

    ``requests`` has ``seq, client_request_id, task_id``.
    """
    named = requests.filter(F.coalesce("client_request_id", F.lit("")) != "")
    first = named.groupBy("client_request_id").agg(F.min_by("task_id", "seq").alias("effective_task_id"))
    plain = requests.filter(F.coalesce("client_request_id", F.lit("")) == "").withColumn(
        "effective_task_id", F.col("task_id")
    )
    return named.join(first, "client_request_id").select(*plain.columns).unionByName(plain)


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Only the requests that start a task."""
    return submit_once(requests).filter(F.col("task_id") == F.col("effective_task_id")).drop("effective_task_id")


# --- task state ---------------------------------------------------------------------


def task_state(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Latest state per task from ``(task_id, seq, kind, stage, progress, details)``.

    Kinds: ``update`` (a stage change empties the counters, present details
    overwrite, also with null), ``cancel`` (later updates are ignored),
    ``completed``, ``failed``, ``cancelled``. A cancel after completion re-opens the
    task as cancelling; after failure or cancellation it does nothing.
    """
    kind = F.col("kind")

    def first(*kinds: str) -> Column:
        return F.min(F.when(kind.isin(*kinds), F.col("seq")))

    marks = events.groupBy("task_id").agg(
        first("failed", "cancelled").alias("ended"), first("cancel").alias("asked"), first("completed").alias("done")
    )
    rows = events.join(marks, "task_id")
    # After a cancel only its outcome counts; failed and cancelled are final.
    after_end = F.coalesce(F.col("seq") > F.col("ended"), F.lit(False))
    after_cancel = F.coalesce(F.col("seq") > F.col("asked"), F.lit(False))
    live = rows.filter(~after_end & ~(after_cancel & kind.isin("update", "completed", "cancel")))
    new_stage = (
        F.when(kind == "update", F.col("stage")).when(kind == "cancel", "cancelling").when(kind == "failed", "error")
    ).otherwise(kind)
    staged = with_running(
        live.withColumn("stage", new_stage),
        ["task_id"],
        ["seq"],
        position_chunk("seq", chunk_rows),
        {"before": Running("last", F.col("stage"), inclusive=False)},
    )
    # Only updates empty the counters on a stage change; a cancelled task loses all of them.
    resets = ((kind == "update") & ~F.col("stage").eqNullSafe(F.col("before"))) | (kind == "cancelled")
    since = staged.groupBy("task_id").agg(F.max(F.when(resets, F.col("seq"))).alias("since"))
    joined = staged.join(since, "task_id")
    inside = F.col("since").isNull() | (F.col("seq") >= F.col("since"))
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround("progress", 1)))
    percent = F.when((kind == "update") & F.col("progress").isNotNull(), clamped).when(kind == "completed", 100.0)
    status = (
        F.when(kind == "update", "running")
        .when((kind == "cancel") & (F.col("done") < F.col("seq")), "running")
        .when(kind != "cancel", kind)
    )
    counters = []
    for name in TASK_COUNTERS:
        present = inside & (kind == "update") & F.coalesce(F.map_contains_key("details", name), F.lit(False))
        counters.append(
            F.max(F.when(present, F.struct("seq", F.try_element_at("details", F.lit(name)).alias("value"))))
            .getField("value")
            .alias(name)
        )
    return joined.groupBy("task_id").agg(
        F.coalesce(
            F.max(F.when(status.isNotNull(), F.struct("seq", status.alias("s")))).getField("s"), F.lit("pending")
        ).alias("status"),
        F.max(F.struct("seq", "stage")).getField("stage").alias("stage"),
        F.max(F.when(kind != "failed", F.struct("seq", percent.alias("p")))).getField("p").alias("progress"),
        *counters,
        F.max("seq").alias("last_seq"),
    )


# --- job state ----------------------------------------------------------------------

JOB_FIELDS = ("status", "stage", "progress", "task_id")


def job_state(events: DataFrame, keep: int = MAX_JOBS) -> DataFrame:
    """Jobs alive after ``(job_id, seq, kind, created_at, patch map)``, newest ``keep`` of an owner.

    Kinds: ``create``, ``patch``, ``delete``. A patch before creation or after deletion
    is dropped. While a job is cancelling only patches that keep that stage count,
    except that a first ``task_id`` is still accepted. ``owner`` groups the jobs that
    share a retention list.
    """
    last_create = events.filter("kind = 'create'").groupBy("owner", "job_id").agg(
        F.max("seq").alias("born"), F.max_by("created_at", "seq").alias("created_at")
    )
    deleted = events.filter("kind = 'delete'").groupBy("owner", "job_id").agg(F.max("seq").alias("gone"))
    alive = last_create.join(deleted, ["owner", "job_id"], "left").filter(
        F.col("gone").isNull() | (F.col("born") > F.col("gone"))
    ).drop("gone")
    rows = events.filter("kind IN ('create', 'patch')").drop("created_at").join(alive, ["owner", "job_id"])
    rows = rows.filter(F.col("seq") >= F.col("born"))
    stage = F.try_element_at("patch", F.lit("stage"))
    cancelling = rows.filter(stage == "cancelling").groupBy("owner", "job_id").agg(F.min("seq").alias("cancelled_at"))
    rows = rows.join(cancelling, ["owner", "job_id"], "left")
    late = F.col("cancelled_at").isNotNull() & (F.col("seq") > F.col("cancelled_at"))
    counts = ~late | (stage == "cancelling")
    task = F.try_element_at("patch", F.lit("task_id"))
    named = F.coalesce(task, F.lit("")) != ""

    def latest(name: str) -> Column:
        has = counts & F.map_contains_key("patch", name)
        value = F.try_element_at("patch", F.lit(name))
        return F.max(F.when(has, F.struct("seq", value.alias("v")))).getField("v")

    merged = rows.groupBy("owner", "job_id").agg(
        F.max("born").alias("born"),
        F.max("created_at").alias("created_at"),
        *[latest(name).alias(name) for name in JOB_FIELDS if name != "task_id"],
        latest("task_id").alias("_task"),
        # The first id that arrives while cancelling fills an empty one.
        F.min(F.when(late & named, F.struct("seq", task.alias("v")))).getField("v").alias("_late_task"),
    )
    filled = F.when(F.coalesce("_task", F.lit("")) != "", F.col("_task")).otherwise(F.col("_late_task"))
    order = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("job_id"))
    return (
        merged.withColumn("task_id", filled)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
        .select("owner", "job_id", "rank", "created_at", *JOB_FIELDS)
    )
