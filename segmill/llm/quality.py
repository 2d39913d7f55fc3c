"""Quality rules as a learned decision list over text statistics.

``text_statistics`` counts inside each row, ``learn_rules`` grows and prunes an
ordered list of threshold conjunctions from labelled rows (sequential covering,
one small aggregation per step), ``verdict`` turns the list into one ordered
conditional expression.

Defined results: a null text has no words; a ratio over nothing is 0. Rows are
judged one by one, so repeated rows get equal verdicts; an empty table gives an
empty result, and without labelled rows of both classes the list is empty and
keeps everything. Other columns are carried; columns with the statistics' names
are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.session import checkpointed

#: Words are runs of other characters than these; a line needs one to count.
_GAPS = "[\\x20\\x09-\\x0D]+"
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_chars")


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the word, symbol, line and repetition counts of each whole text (longs named as in ``STATISTICS``)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in STATISTICS]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = df.select(
        *kept,
        F.array_remove(F.split(body, _GAPS), "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).alias("_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).alias("_upper"),
        F.char_length(body).alias("_chars"),
    )
    windows = F.expr(
        """CASE WHEN size(_words) >= 5 THEN transform(sequence(0, size(_words) - 5),
               i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) END"""
    )
    hashed = split.withColumn("_windows", windows)
    # windows in order of their hash: equal ones are neighbours, and their positions are put in order again
    sorted_windows = "array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i)))"
    twice = f"""transform(array({sorted_windows}), s -> array_sort(transform(
        filter(s, (e, k) -> (k > 0 AND s[k - 1].h = e.h) OR (k < size(s) - 1 AND s[k + 1].h = e.h)), e -> e.i)))[0]"""
    covered = f"""aggregate({twice}, struct(0L AS n, -5 AS last),
        (a, i) -> struct(a.n + least(5, i - a.last) AS n, i AS last), a -> a.n)"""
    repeated = f"CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN {covered} ELSE 0L END"
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.col("_symbols"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.expr(repeated),
        "n_lines": F.size("_lines"),
        "n_distinct": F.size(F.array_distinct("_words")),
        "n_upper": F.col("_upper"),
        "n_chars": F.col("_chars"),
    }
    return hashed.select(*kept, *[value.cast("long").alias(name) for name, value in counts.items()])


def features() -> dict[str, Column]:
    """What the list's conditions test, from the statistics."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "n_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def expression(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.cut if self.above else values[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``bad`` and ``good`` are the rows of each class it met when pruned."""

    conditions: tuple[Condition, ...] = field(default=())
    bad: int = 0
    good: int = 0

    def expression(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.expression(values)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> reject ({self.bad} bad, {self.good} good)"


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """Information that a condition gains on the bad rows it keeps."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else -1.0


def learn_rules(
    labelled: DataFrame, bad: str, max_rules: int = 8, max_conditions: int = 3, cuts: int = 24, least_precision: float = 0.95, least_bad: int = 5
) -> list[Rule]:
    """An ordered list that rejects rows whose boolean column ``bad`` is true.

    ``labelled`` holds the statistics and every labelled row takes part. Two
    thirds of the rows grow a rule, the rest prune it, both over what earlier
    rules left. A rule enters if, on the pruning rows, it meets at least
    ``least_bad`` bad rows and its share of bad rows reaches ``least_precision``.
    Only counts per (feature, cut) come to the driver.
    """
    named = features()
    rows = labelled.where(F.col(bad).isNotNull()).select(
        F.col(bad).alias("_bad"),
        (F.pmod(F.xxhash64(*STATISTICS), F.lit(3)) > 0).alias("_grow"),
        *[value.alias(name) for name, value in named.items()],
    )
    rows = checkpointed(rows)
    shares = [k / cuts for k in range(1, cuts)]
    quantiles = rows.groupBy("_bad").agg(*[F.percentile_approx(x, shares, 10_000).alias(x) for x in FEATURES]).collect()
    if len(quantiles) < 2:
        return []
    edges = {x: sorted({cut for row in quantiles for cut in row[x]}) for x in FEATURES}
    values = {x: F.col(x) for x in FEATURES}
    banded = {x: sum([F.when(values[x] > cut, 1).otherwise(0) for cut in edges[x]], F.lit(0)) for x in FEATURES}
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), banded[x].alias("band")) for x in FEATURES]))
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        growing = left.where("_grow")
        while len(conditions) < max_conditions:
            counted = growing.select("_bad", pairs.alias("p")).groupBy("p.feature", "p.band", "_bad").count().collect()
            best, total = _best_condition(counted, edges)
            if best is None or not total[1] and conditions:
                break
            conditions.append(best)
            growing = growing.where(best.expression(values))
        if not conditions:
            break
        rule = _pruned(left.where("NOT _grow"), conditions, values)
        if rule.bad < least_bad or rule.bad < least_precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        left = left.where(~rule.expression(values))
    return rules


def _best_condition(counted: list, edges: dict[str, list[float]]) -> tuple[Condition | None, tuple[int, int]]:
    """The condition of highest gain, from counts per band; also the bad and good rows before it."""
    total, best, most = (0, 0), None, 1e-9
    for feature in FEATURES:
        sums = [[0, 0] for _ in range(len(edges[feature]) + 1)]
        for row in counted:
            if row["feature"] == feature:
                sums[row["band"]][0 if row["_bad"] else 1] += row["count"]
        total = tuple(sum(x[k] for x in sums) for k in (0, 1))
        if not total[0]:
            return None, total
        below = [0, 0]
        for cut, here in zip(edges[feature], sums, strict=False):  # band k lies below cut k
            below = [a + b for a, b in zip(below, here, strict=True)]
            for above, (bad, good) in ((False, below), (True, [t - x for t, x in zip(total, below, strict=True)])):
                if (gain := _gain(bad, good, *total)) > most:
                    best, most = Condition(feature, above, cut), gain
    return best, total


def _pruned(rows: DataFrame, conditions: list[Condition], values: dict[str, Column]) -> Rule:
    """The prefix of the conjunction with the best share of bad over good rows; ties: the shortest."""
    prefixes = [tuple(conditions[:k]) for k in range(1, len(conditions) + 1)]
    sums = []
    for k, prefix in enumerate(prefixes):
        met = Rule(prefix).expression(values)
        sums += [F.count_if(met & F.col("_bad")).alias(f"bad{k}"), F.count_if(met & ~F.col("_bad")).alias(f"good{k}")]
    row = rows.agg(*sums).first()
    found = [Rule(prefix, row[f"bad{k}"], row[f"good{k}"]) for k, prefix in enumerate(prefixes)]
    return max(found, key=lambda r: ((r.bad - r.good) / max(1, r.bad + r.good), -len(r.conditions)))


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one conditional expression, rules in order."""
    values, out = features(), None
    for rule in rules:
        met = rule.expression(values)
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    """The fixed rule before the learned ones: too short, or too much of the text in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every row, and the learned rules.

    ``labels`` has ``doc_id`` and ``quality``; quality 0 is bad. A document with
    several labels is bad if one says so.
    """
    told = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = checkpointed(text_statistics(told).drop("text"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 0).alias("_bad"))
    rules = learn_rules(counted.join(marks, "doc_id"), "_bad")
    failed = base_failed()
    return counted.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)}), rules


def keep_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that neither the base rule nor a learned one rejects, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    counted = checkpointed(text_statistics(whole, "_text").drop("_text"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 0).alias("_bad"))
    rules = learn_rules(counted.join(marks, F.col("_doc") == F.col("doc_id")).select("_bad", *STATISTICS), "_bad")
    return counted.where(~base_failed() & verdict(rules)).select("_row.*")
