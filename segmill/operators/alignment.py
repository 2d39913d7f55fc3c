"""Edges of a second-pass text aligned with the first pass.

A second pass over a clip may cut words at its edges or invent some. What both passes agree
on is found by anchors: triples of words that occur in both texts are joined by equality,
anchors on one diagonal that touch are a run, and of all chains of runs that go forward
in both texts the one with the most words is taken. The revised text between the first
and the last run of that chain is the core; each edge outside it is the revised one if its
length is plausible, else the original one.

Pairs of short texts, as a segment's are, find their triples inside their row, so nothing is
shuffled for them. Longer ones meet by joins on pair and triple of words, whose size is the
number of equal triples in a pair's two texts. The runs of one pair form one chain problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmill.functions.arrays import let
from segmill.functions.text import fold_yo, strip
from segmill.session import checkpointed

# Words of an anchor, word pattern, and how far a revised edge's length may be from the original's.
ANCHOR = 3
ALIGN_WORD = "[A-Za-zА-Яа-яЁё0-9]+"
LEAST_EDGE = 0.55
MOST_EDGE = 1.7
MORE_WORDS = 3

# Pairs of so many characters in both texts together are aligned inside their row.
ROW_CHARS = 1_024
# An equal triple inside a row is one number: its diagonal times this, plus its position in the original.
WIDE = 1 << 20
ENDS = ("a", "b", "a_end", "b_end")
# Stands between words.
MARK = "\x1f"


def _triples(words: Column) -> Column:
    size = F.size(words)
    places = F.when(size >= ANCHOR, F.sequence(F.lit(0), size - ANCHOR)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(places, lambda k: F.concat_ws(" ", *(F.get(w, k + i) for i in range(ANCHOR)))))


def _anchors(pairs: DataFrame, keys: list[str], words: str, at: str) -> DataFrame:
    """The triples of one text: ``keys``, ``anchor`` and its position ``at``."""
    return pairs.select(*keys, F.posexplode(_triples(F.col(words))).alias(at, "anchor"))


def matching_runs(pairs: DataFrame, keys: list[str], original: str = "original_words", revised: str = "revised_words") -> DataFrame:
    """Runs of equal words of at least ``ANCHOR``: ``keys, a, b`` (positions in both texts) and ``size``.

    ``pairs`` has the texts as arrays of words.
    """
    met = _anchors(pairs, keys, original, "a").join(_anchors(pairs, keys, revised, "b"), [*keys, "anchor"])
    diagonal = met.withColumn("diagonal", F.col("a") - F.col("b"))
    place = F.row_number().over(Window.partitionBy(*keys, "diagonal").orderBy("a"))
    islands = diagonal.withColumn("island", F.col("a") - place)
    return islands.groupBy(*keys, "diagonal", "island").agg(
        F.min("a").alias("a"), F.min("b").alias("b"), (F.count(F.lit(1)) + ANCHOR - 1).cast("int").alias("size")
    ).drop("diagonal", "island")


def row_runs(original: Column, revised: Column) -> Column:
    """``matching_runs`` of two arrays of words inside their row, as an array in the order of their ends."""

    def number(a: Column, b: Column) -> Column:
        return (a - b) * F.lit(WIDE).cast("bigint") + a

    def places(place: Column) -> tuple[Column, Column]:
        a = place.bitwiseAND(F.lit(WIDE - 1).cast("bigint"))
        return a.cast("int"), (a - F.shiftright(place, 20)).cast("int")

    def met(x: Column, y: Column) -> Column:
        # Where no triple comes twice in the revised text, a triple has one place there, or -1.
        one = F.filter(F.transform(x, lambda t, a: number(a, F.array_position(y, t) - 1)), lambda place: places(place)[1] >= 0)
        each = F.flatten(F.transform(x, lambda t, a: F.filter(F.transform(y, lambda u, b: F.when(u == t, number(a, b))), F.isnotnull)))
        return F.sort_array(F.when(F.size(F.array_distinct(y)) == F.size(y), one).otherwise(each))

    def runs(m: Column) -> Column:
        starts = F.filter(m, lambda place, i: ~F.get(m, i - 1).eqNullSafe(place - 1))
        ends = F.filter(m, lambda place, i: ~F.get(m, i + 1).eqNullSafe(place + 1))
        return F.array_sort(F.zip_with(starts, ends, lambda start, end: run(*places(start), *places(end))))

    def run(a: Column, b: Column, a_last: Column, b_last: Column) -> Column:
        return _run(a, b, a_last - a + ANCHOR)

    triples = F.struct(_triples(original).alias("x"), _triples(revised).alias("y"))
    return let(let(triples, lambda t: met(t["x"], t["y"])), runs)


def _with_row_chain(pairs: DataFrame, original: str, revised: str) -> DataFrame:
    """Add ``_c``, the heaviest chain of each pair inside its row.

    Where one text is a part of the other, in which no word comes twice, they share one run,
    the whole shorter text, and no triples are made.
    """
    sides = {"_o": original, "_r": revised}
    texts = {at: F.concat(F.lit(MARK), F.array_join(words, MARK), F.lit(MARK)) for at, words in sides.items()}
    sizes = {f"{at}_size": F.size(words) for at, words in sides.items()}
    rows = pairs.withColumns(texts | sizes)

    def inside(longer: str, shorter: str) -> tuple[Column, Column]:
        found = F.instr(F.col(longer), F.col(shorter))
        before = F.substring(longer, F.lit(1), found - 1)
        told = F.size(F.array_distinct(sides[longer])) == F.col(f"{longer}_size")
        fits = (F.col(f"{shorter}_size") >= ANCHOR) & (F.col(f"{shorter}_size") <= F.col(f"{longer}_size"))
        return fits & (found > 0) & told, F.length(before) - F.length(F.replace(before, F.lit(MARK), F.lit("")))

    (within, b), (holds, a) = inside("_r", "_o"), inside("_o", "_r")
    none = F.lit(0)
    chain = (
        F.when(within, _ends(none, b, F.col("_o_size")))
        .when(holds, _ends(a, none, F.col("_r_size")))
        .otherwise(chain_of(row_runs(F.col(original), F.col(revised))))
    )
    return rows.withColumn("_c", chain).drop(*texts, *sizes)


def _ends(a: Column, b: Column, size: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), (a + size).alias("a_end"), (b + size).alias("b_end"))


def _run(a: Column, b: Column, size: Column) -> Column:
    return F.struct((a + size).alias("a_end"), (b + size).alias("b_end"), a.alias("a"), b.alias("b"), size.alias("size"))


def heaviest_chain(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The chain of runs with the most words: ``keys``, its first word ``a, b`` and the ends ``a_end, b_end`` of its last run.

    Runs of a chain end later in both texts than the one before. Where two overlap, the later
    one only counts from the end of the earlier, and needs ``ANCHOR`` words there. Of equal
    chains the one that begins first, then the one that ends first is taken.
    """
    run = _run(F.col("a"), F.col("b"), F.col("size"))
    grouped = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return grouped.select(*keys, chain_of(F.col("runs")).alias("c")).select(*keys, "c.*")


def chain_of(runs: Column) -> Column:
    """The heaviest chain of an array of runs in the order of their ends: a struct ``a, b, a_end, b_end``, null without runs."""

    def made(weight: Column, a: Column, b: Column, r: Column) -> Column:
        # Greatest first: more words, then an earlier begin, then an earlier end.
        return F.struct(
            weight.cast("int").alias("weight"), (-a).alias("a"), (-b).alias("b"), (-r["a_end"]).alias("a_end"), (-r["b_end"]).alias("b_end")
        )

    def best(chains: Column, r: Column) -> Column:
        def rest(c: Column) -> Column:  # words of the run after the chain's end; ends are negative
            return r["size"] - F.greatest(F.lit(0), -c["a_end"] - r["a"], -c["b_end"] - r["b"])

        before = F.filter(chains, lambda c: (-c["a_end"] < r["a_end"]) & (-c["b_end"] < r["b_end"]) & (rest(c) >= ANCHOR))
        longer = F.transform(before, lambda c: made(c["weight"] + rest(c), -c["a"], -c["b"], r))
        return F.array_max(F.concat(longer, F.array(made(r["size"], r["a"], r["b"], r))))

    none = F.array().cast("array<struct<weight:int,a:int,b:int,a_end:int,b_end:int>>")
    def top(runs: Column) -> Column:
        chains = F.aggregate(runs, none, lambda chains, r: F.concat(chains, F.array(best(chains, r))))
        only = F.get(runs, F.lit(0))
        alone = F.struct(*(only[name].alias(name) for name in ENDS))
        most = let(F.array_max(chains), lambda c: F.when(c.isNotNull(), F.struct(*((-c[name]).alias(name) for name in ENDS))))
        return F.when(F.size(runs) == 1, alone).when(F.size(runs) > 1, most)

    return let(runs, top)


def _start(words: str, gaps: str, k: Column) -> Column:
    """Characters before word ``k``."""
    return F.length(F.array_join(F.slice(gaps, 1, k + 1), "")) + F.length(F.array_join(F.slice(words, 1, k), ""))


def _edge(at: int) -> Column:
    """The revised one of two ``_edges`` if it has a plausible number of words, else the original one."""
    (original, had), (revised, has) = ((F.get("_edges", F.lit(k)), F.get("_counts", F.lit(k))) for k in (at, at + 1))
    plausible = (has >= F.greatest(F.lit(1), F.floor(had * LEAST_EDGE))) & (has <= F.greatest(had + MORE_WORDS, F.ceil(had * MOST_EDGE)))
    return (
        F.when(had == 0, F.when(has == 0, original).otherwise(""))
        .when(has == 0, original)
        .when(plausible, revised)
        .otherwise(original)
    )


def align_revision_boundaries(pairs: DataFrame, keys: tuple[str, ...] = ("rec_id", "seg_idx"), word: str = ALIGN_WORD) -> DataFrame:
    """Add ``aligned`` to pairs of ``original`` and ``revised`` text, which ``keys`` tell apart.

    Texts of fewer than ``ANCHOR`` words, or without a common run, keep the revised text.
    """
    keys = list(keys)
    words = {}
    for side in ("original", "revised"):
        folded = fold_yo(F.lower(F.col(side)))
        words[f"_{side}_words"] = F.coalesce(F.regexp_extract_all(folded, F.lit(word), F.lit(0)), F.array().cast("array<string>"))
    names = list(words)
    short = F.coalesce(F.length("original") + F.length("revised") <= ROW_CHARS, F.lit(True))
    here = _with_row_chain(pairs.filter(short).withColumns(words), *names)
    long = checkpointed(pairs.filter(~short).withColumns(words))
    chains = heaviest_chain(matching_runs(long, keys, *names), keys).select(*keys, F.struct(*ENDS).alias("_c"))
    met = here.unionByName(long.join(chains, keys, "left"))
    made = _with_edges(met, word).withColumn("aligned", F.coalesce("_aligned", strip(F.col("revised"))))
    return made.select(*pairs.columns, "aligned")


def _with_edges(met: DataFrame, word: str) -> DataFrame:
    """Add ``_aligned``, core and chosen edges of pairs with a chain ``_c``; null without one."""
    met = met.withColumns({f"_{side}_gaps": F.split(side, word, -1) for side in ("original", "revised")})
    o_last, r_last = F.col("_c.a_end") - 1, F.col("_c.b_end") - 1
    bounds = {
        "_o_from": _start("_original_words", "_original_gaps", F.col("_c.a")),
        "_r_from": _start("_revised_words", "_revised_gaps", F.col("_c.b")),
        "_o_to": _start("_original_words", "_original_gaps", o_last) + F.length(F.get("_original_words", o_last)),
        "_r_to": _start("_revised_words", "_revised_gaps", r_last) + F.length(F.get("_revised_words", r_last)),
    }
    left = [F.substring(side, F.lit(1), F.col(to)) for side, to in (("original", "_o_from"), ("revised", "_r_from"))]
    right = [F.substring(side, F.col(at) + 1, F.length(side)) for side, at in (("original", "_o_to"), ("revised", "_r_to"))]
    core = strip(F.substring("revised", F.col("_r_from") + 1, F.col("_r_to") - F.col("_r_from")))
    met = met.withColumns(bounds).withColumns({"_edges": F.transform(F.array(*left, *right), strip), "_core": core})
    met = met.withColumn("_counts", F.transform("_edges", lambda edge: F.regexp_count(edge, F.lit(word))))
    parts = [_edge(0), F.col("_core"), _edge(2)]
    # Empty parts leave no space behind.
    joined = F.concat_ws(" ", *(F.nullif(part, F.lit("")) for part in parts))
    return met.withColumn("_aligned", F.when(F.col("_c").isNotNull(), strip(joined)))
