"""URL filtering: listed rules first, gradient-boosted trees on lexical features for the rest.

Features are lengths, depth, digit ratio, entropy, parameter counts and the
record of the host's endings among the labelled URLs. The trees are Spark ML's,
fitted on labelled URLs; everything else is DataFrame functions.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged by its features like others. Repeated rows get equal
verdicts. Without labelled URLs of both classes the verdict is that of the one
class there is, else allow. An empty table gives an empty result. Other columns
are ignored by ``judge_urls`` but for the key.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.session import checkpointed

#: Labelled URLs that the trees are fitted on at most: those with the least hashes.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDINGS = {"tld": 1, "domain": 2}
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy",
    "parameters", "hyphens", "longest_segment", "has_extension",
    *[f"{x}_{y}" for x in ENDINGS for y in ("rate", "seen")],
)

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased and the path; both empty without ``://``."""
    body = F.coalesce(url, F.lit(""))
    at = F.instr(body, "://")
    rest = F.when(at > 0, body.substr(at + 3, F.char_length(body))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(name: str, verdict: str) -> Rule:
    """A rule written like ``example.net/en/``: host, path with its first slash, verdict."""
    host, slash, path = name.partition("/")
    return host, slash + path, verdict


def listed(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct ``rule, verdict``, else null; ``rules`` is a short list, longest first."""
    out = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if out is None else out


def _ending(labels: int) -> Column:
    return F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, labels), ".")


def lexical_features(df: DataFrame) -> DataFrame:
    """Add the features of ``url``, ``host`` and ``path`` but for the endings' records, and the endings themselves."""
    body = F.coalesce("url", F.lit(""))
    size = F.char_length(body)
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    shares = F.transform(F.array_distinct(chars), lambda c: (size - F.char_length(F.replace(body, c, F.lit("")))) / size)
    segments = F.transform(F.split("path", "/"), F.char_length)
    return df.withColumns(
        {
            "url_length": size,
            "host_length": F.char_length("host"),
            "path_length": F.char_length("path"),
            "depth": F.regexp_count("path", F.lit("/")),
            "host_labels": F.size(F.split("host", r"\.")),
            "digit_ratio": F.when(size > 0, F.regexp_count(body, F.lit("[0-9]")) / size).otherwise(F.lit(0.0)),
            "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "parameters": F.regexp_count(body, F.lit("[?&][^=&#]*=")),
            "hyphens": F.regexp_count(body, F.lit("-")),
            "longest_segment": F.array_max(segments),
            "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
            **{x: _ending(labels) for x, labels in ENDINGS.items()},
        }
    )


def _with_records(df: DataFrame, records: dict[str, DataFrame], share: float) -> DataFrame:
    """Add the smoothed share of blocked URLs and the number of labelled URLs with the same ending."""
    for name, record in records.items():
        df = df.join(record, name, "left").withColumns(
            {f"{name}_rate": F.coalesce(f"{name}_rate", F.lit(share)), f"{name}_seen": F.coalesce(f"{name}_seen", F.lit(0.0))}
        )
    return df.withColumns({x: F.col(x).cast("double") for x in FEATURES})


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    ``labelled`` has ``url`` and ``verdict`` (block or allow). The score is the
    trees' probability of block; a rule's verdict stands before theirs.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rows = lexical_features(rows).withColumn("_listed", listed(F.col("host"), F.col("path"), rules))

    host, path = host_and_path(F.col("url"))
    known = labelled.select("url", F.when(F.col("verdict") == "block", 1.0).otherwise(0.0).alias("label"), host.alias("host"), path.alias("path"))
    known = checkpointed(lexical_features(known))
    count, blocked = known.agg(F.count("*"), F.sum("label")).first()
    share = (blocked or 0.0) / max(1, count)
    if share in (0.0, 1.0):
        judged = rows.withColumn("score", F.lit(share))
    else:
        records = {
            name: checkpointed(
                known.groupBy(name).agg(
                    ((F.sum("label") + share) / (F.count("*") + 1)).alias(f"{name}_rate"), F.count("*").cast("double").alias(f"{name}_seen")
                )
            )
            for name in ENDINGS
        }
        sample = _with_records(known.orderBy(F.xxhash64("url", "label"), "url").limit(SAMPLE), records, share)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, maxMemoryInMB=64)
        model = trees.fit(vectors.transform(checkpointed(sample.select("label", *FEATURES))))
        scored = model.transform(vectors.transform(_with_records(rows, records, share)))
        judged = scored.withColumn("score", F.get(vector_to_array("probability"), 1))
    verdict = F.coalesce(F.col("_listed.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"), "score")
