"""Event streams from files or Kafka with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import urls
from segmill.schemas import REQUEST_EVENTS


def usable_traffic(events: DataFrame) -> DataFrame:
    """http(s) traffic that belongs to a tab."""
    return events.filter((F.col("tab_id") >= 0) & urls.is_http(F.col("url")))


def read_request_events(
    spark: SparkSession, path: str, fmt: str = "json", schema: str = REQUEST_EVENTS, **options: str
) -> DataFrame:
    """Request and response events from a growing folder of files."""
    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    return usable_traffic(stream.withColumn("ts", F.col("ts").cast("timestamp")))


def read_request_topic(spark: SparkSession, schema: str = REQUEST_EVENTS, **options: str) -> DataFrame:
    """The same events as JSON values of a Kafka topic; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**options).load()
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
    return usable_traffic(parsed)
