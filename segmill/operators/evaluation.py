"""Text quality: pairing, word and character error rates, comparison of engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.text import fold_yo, strip
from segmill.functions.udfs import html_unescape, nfkc_casefold
from segmill.operators.distance import with_edits

# Token classes of the error rates.
RU_EN_WORD = r"[a-zа-я0-9]+"
ANY_WORD = r"[\p{L}\p{N}]+"


class CountMismatch(ValueError):
    """The two sides of a strict pairing differ."""


def pair_texts(reference: DataFrame, hypothesis: DataFrame, keys: tuple[str, ...] = ("rec_id",), strict: bool = False) -> DataFrame:
    """Join texts on ``keys``; ``differs`` tells if they differ apart from outer white space."""
    keys = list(keys)
    left = reference.select(*keys, F.col("text").alias("reference"))
    right = hypothesis.select(*keys, F.col("text").alias("hypothesis"))
    if strict:
        lone = left.join(right, keys, "left_anti").select(*keys).unionByName(
            right.join(left, keys, "left_anti").select(*keys)
        )
        first = lone.first()
        if first is not None:
            raise CountMismatch(f"no partner for {first.asDict()}")
    return left.join(right, keys).withColumn(
        "differs", strip(F.col("reference")) != strip(F.col("hypothesis"))
    )


def replacements(pairs: DataFrame, by: str = "rec_id") -> DataFrame:
    return pairs.groupBy(by).agg(F.sum(F.col("differs").cast("int")).alias("replacements"))


def _words(text: Column, token: str) -> Column:
    return F.regexp_extract_all(fold_yo(nfkc_casefold(html_unescape(text))), F.lit(token), F.lit(0))


def word_error_rate(pairs: DataFrame, terms: Column | None = None, token: str = RU_EN_WORD) -> DataFrame:
    """WER and CER in percent of each pair, with counts; ``terms`` are looked up in the hypothesis.

    Distances of pairs of any length: see ``segmill.operators.distance``.
    """
    rows = pairs.withColumns(
        {"_ref": F.array_join(_words(F.col("reference"), token), " "), "_hyp": F.array_join(_words(F.col("hypothesis"), token), " ")}
    )
    rows = with_edits(rows, F.col("_ref"), F.col("_hyp"))
    count = lambda words: F.when(F.col(words) == "", 0).otherwise(F.size(F.split(words, " ")))
    rows = rows.withColumns(
        {
            "reference_words": count("_ref"),
            "hypothesis_words": count("_hyp"),
            "_ref_chars": F.length(F.replace(F.col("_ref"), F.lit(" "), F.lit(""))),
        }
    )
    percent = lambda edits, length: F.bround(F.col(edits) / F.greatest(F.lit(1), F.col(length)) * 100, 2)
    rows = rows.withColumns(
        {"wer_percent": percent("word_edits", "reference_words"), "cer_percent": percent("char_edits", "_ref_chars")}
    )
    if terms is not None:
        found = F.filter(terms, lambda term: F.contains(F.lower("hypothesis"), F.lower(term)))
        rows = rows.withColumns(
            {"terms_found": found, "terms_found_count": F.size(found), "terms_total": F.size(terms)}
        )
    return rows.drop("_ref", "_hyp", "_ref_chars")


def engine_comparison(results: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """One row per case: ``seconds_*, wer_*, cer_*`` of each engine.

    ``results`` has ``case_id, engine, seconds, wer_percent, cer_percent``.
    """
    pivoted = results.groupBy("case_id").pivot("engine", list(engines)).agg(
        F.sum("seconds").alias("seconds"), F.max("wer_percent").alias("wer"), F.max("cer_percent").alias("cer")
    )
    return pivoted.select(
        "case_id",
        *[F.col(f"{e}_{m}").alias(f"{m}_{e}") for e in engines for m in ("seconds", "wer", "cer")],
    )


def total_speedup(comparison: DataFrame, slow: str, fast: str) -> DataFrame:
    """Ratio of summed times over the cases both engines ran."""
    both = comparison.filter(F.col(f"seconds_{slow}").isNotNull() & F.col(f"seconds_{fast}").isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(f"seconds_{slow}").alias("slow_seconds"),
        F.sum(f"seconds_{fast}").alias("fast_seconds"),
        (F.sum(f"seconds_{slow}") / F.sum(f"seconds_{fast}")).alias("speedup"),
    )


def candidate_share(candidates: DataFrame, recordings: DataFrame) -> DataFrame:
    """Percent of a recording's duration that went to review (``duration_ms`` at least one second)."""
    reviewed = candidates.groupBy("rec_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("reviewed_ms"), F.count(F.lit(1)).alias("candidates")
    )
    share = F.coalesce("reviewed_ms", F.lit(0)) / F.greatest(F.lit(1000), F.col("duration_ms")) * 100
    return recordings.select("rec_id", "duration_ms").join(reviewed, "rec_id", "left").select(
        "rec_id",
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("reviewed_ms", F.lit(0)).alias("reviewed_ms"),
        F.bround(share, 2).alias("share_percent"),
    )
