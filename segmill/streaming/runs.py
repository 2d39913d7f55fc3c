"""The streaming operators run to completion over the event table as a file stream.

Each run writes its batches to the shared checkpoint folder, one folder per batch so
that a repeated batch replaces itself, and returns the table it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.operators import requests as req
from segmill.operators.tasks import MAX_JOBS
from segmill.plans import views as v
from segmill.session import checkpoint_folder
from segmill.streaming import joins, state
from segmill.streaming.ordered import STATE_STORE, late_rows, settled


def _events(spark: SparkSession, sf_dir: str) -> Callable[[SparkSession, str, str], DataFrame]:
    """A table reader that streams ``events`` and reads everything else as it is."""

    def read(session: SparkSession, folder: str, name: str) -> DataFrame:
        if name != "events":
            return v.table(session, folder, name)
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        stream = session.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
        return stream.withColumn("ts", F.col("ts").cast("timestamp"))

    return read


def run_to_table(df: DataFrame, mode: str, state_store: str | None = None, place: str | None = None) -> DataFrame:
    """Process all available input and return what was written; ``place`` goes on with an earlier run's state and output."""
    spark = df.sparkSession
    place = place or f"{checkpoint_folder(spark)}/segmill-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    if state_store:
        spark.conf.set(setting, state_store)
    try:
        query = (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{place}/checkpoint")
            .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{place}/out/batch={batch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if state_store:
            spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(df.schema).parquet(f"{place}/out").drop("batch")


def run_in_turns(rows: DataFrame, turn: str, turns: int, operator: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Hand ``rows`` to a streaming operator turn by turn, as they arrived; each turn resumes the state of the one before."""
    spark = rows.sparkSession
    place = f"{checkpoint_folder(spark)}/segmill-{uuid.uuid4().hex}"
    kept = rows.drop(turn)
    for now in range(turns):
        rows.filter(F.col(turn) == now).select(*kept.columns).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(kept.schema).parquet(f"{place}/in")
        out = run_to_table(operator(stream), mode, STATE_STORE, place)
    return out


def _heartbeat(spark: SparkSession, events: DataFrame) -> DataFrame:
    """A stream of one time, a day after the last of a bounded table: the watermark passes all its rows, so answers become final."""
    place = f"{checkpoint_folder(spark)}/segmill-{uuid.uuid4().hex}"
    last = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    last.write.parquet(place)
    return spark.readStream.schema(last.schema).parquet(place)


def _newest(rows: DataFrame, *keys: str, by: str = "version") -> DataFrame:
    """Of the states a key went through, the last one."""
    states = settled(rows)
    last = states.groupBy(*keys).agg(F.max(by).alias(by))
    return states.join(last, [*keys, by])


def _with_stream(spark: SparkSession, sf_dir: str, view: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    return view(spark, sf_dir, _events(spark, sf_dir))


def candidate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _with_stream(spark, sf_dir, v.request_events)
    events = events.withColumn("headers", req.scrubbed_headers(F.col("headers")))
    return _newest(run_to_table(state.track_stream_candidates(events, lifetime_ms=None), "update", STATE_STORE), "tab_id")


def task_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _with_stream(spark, sf_dir, v.task_events)
    return _newest(run_to_table(state.task_state_stream(events, lifetime_ms=None), "update", STATE_STORE), "task_id")


def late_task_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks whose rows arrive in three turns, some of them late: the states, and the audit of rows too late to count."""
    rows = run_in_turns(v.arriving_task_events(spark, sf_dir), "turn", 3, lambda s: state.task_state_stream(s, lifetime_ms=None), "update")
    return _newest(rows, "task_id"), late_rows(rows, "task_id")


def job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _with_stream(spark, sf_dir, v.job_events)
    jobs = _newest(run_to_table(state.job_state_stream(events, lifetime_ms=None), "update", STATE_STORE), "owner", "job_id")
    order = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.filter("alive").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_JOBS)


def join_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, responses = v.traffic(spark, sf_dir, _events(spark, sf_dir))
    end = _heartbeat(spark, v.traffic(spark, sf_dir)[1]).select(F.lit("").alias("request_id"), "ts")
    met = joins.join_request_response_stream(requests, responses, end)
    return settled(run_to_table(met, "append", STATE_STORE))


def submit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _with_stream(spark, sf_dir, v.submissions)
    end = _heartbeat(spark, v.submissions(spark, sf_dir)).select("ts")
    rows = state.submit_once_stream(requests.unionByName(end, allowMissingColumns=True), lifetime_ms=None)
    return settled(run_to_table(rows, "append", STATE_STORE)).filter("seq IS NOT NULL")
