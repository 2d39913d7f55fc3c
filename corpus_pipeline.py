"""The training-data pipeline over ``documents``: quality rules, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that go on; all
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmill.llm.packing import pack, token_pieces
from segmill.llm.pii import sanitise
from segmill.llm.quality import keep_documents
from segmill.llm.simhash import keep_one
from segmill.llm.tables import table, vocabulary
from segmill.session import checkpointed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the rules are learned from the labelled ones among ``docs``."""
    return keep_documents(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash fingerprints, linked at 4 or fewer differing bits) stays."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced in every text."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 1024: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``."""
    pieces = checkpointed(token_pieces(docs, vocabulary(spark, "byte_bpe_50k.json")))
    return pack(pieces, ["doc_id", "start", "doc_tokens"])


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Learned rules, XXH64 fingerprints and byte-level BPE have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each one's result written and read again."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = checkpointed(stage(spark, rows, sf_dir))
    return rows
