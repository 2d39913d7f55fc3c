"""One query per operator: it applies the operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm.bpe import decode, encode
from segmill.llm.centroids import cluster, with_inertia
from segmill.llm.chat import format_turns, read_back
from segmill.llm.embeddings import near_duplicates as near_embeddings
from segmill.llm.hilbert import hilbert_shards, with_rank
from segmill.llm.integers import digest
from segmill.llm.lm_scoring import cross_entropy_difference
from segmill.llm.packing import pack, token_pieces
from segmill.llm.pii import PATTERNS, find, span_list
from segmill.llm.quality import judge
from segmill.llm.simhash import near_duplicates
from segmill.llm.tables import table, vocabulary
from segmill.llm.token_counts import token_counts
from segmill.llm.urls import host_and_path, judge_urls, listed, split_rule
from segmill.llm.vector_codes import compress, with_label_error
from segmill.session import checkpointed


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), vocabulary(spark, "byte_bpe_50k.json"))
    pieces = checkpointed(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(pieces, ["doc_id", "start", "ids_crc32"])


#: The listed rules of the URL filter: fixed values of its contract.
URL_RULES = [
    split_rule("net/", "block"),
    split_rule("example.net/en/", "allow"),
    split_rule("example.com/de/", "block"),
    split_rule("org/fr/", "allow"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the URLs that a rule judges are the labelled ones."""
    pages = table(spark, sf_dir, "pages")
    known = pages.select("url", listed(*host_and_path(F.col("url")), URL_RULES).alias("l")).where("l IS NOT NULL")
    return judge_urls(pages, known.select("url", "l.verdict"), URL_RULES)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of every document under a model of ``benchmark`` less that under a model of all documents."""
    target = table(spark, sf_dir, "benchmark").select("text")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 runs along a Hilbert curve over language, source and length."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        "lang",
        "source",
        F.char_length("text").cast("double").alias("_length"),
    )
    rows = checkpointed(rows)
    rows = with_rank(with_rank(rows, "lang", "_lang"), "source", "_source").drop("lang", "source")
    placed = hilbert_shards(checkpointed(rows), ["_lang", "_source", "_length"], 24, ["doc_id", "text_crc32", "size"], "size")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes they decode to, as digests."""
    ranks = vocabulary(spark, "byte_bpe_50k.tiktoken")
    back = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data, and of the terms that give it away, in every document."""
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{x}')")).cast("long").alias(f"n_{x}") for x in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the rules are learned from ``labels``."""
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    ranks = vocabulary(spark, "byte_bpe_50k.tiktoken")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    told = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return read_back(format_turns(rows.unionByName(told), ranks), ranks)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector of 64 components, after five rounds with 40 centroids."""
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are more than 512."""
    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary(spark, "byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four bytes of all vectors, from codebooks of 256 entries trained in four rounds."""
    found, books = compress(table(spark, sf_dir, "embeddings"))
    hexed = with_label_error(found).withColumn("code", F.lower(F.hex("code")))
    return hexed.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash": op4_simhash,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat": op9_chat,
    "op10_embeddings": op10_embeddings,
    "op11_centroids": op11_centroids,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}
