"""Reading the tables and handing bounded files to tasks."""

from __future__ import annotations

from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(spark: SparkSession, name: str, path: str | None = None) -> Broadcast:
    """The bytes of a tokenizer's file, read by the driver and broadcast.

    ``path`` names the file; without it ``name`` is looked up among the public
    tokenizers. Such files hold a fixed vocabulary (under 2 MB here), whatever
    the size of the corpus.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return spark.sparkContext.broadcast(Path(path).read_bytes())
