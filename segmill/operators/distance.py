"""Edit distance between two sequences of any length: tiles of bit vectors inside a band.

The table of the classic recurrence is cut into square tiles. A tile needs the
differences along its left and its upper edge and gives those along its right and
lower edge; inside, a column is one step on whole bit vectors. A pair of one tile is
done in its own row. Longer pairs go by anti-diagonals of tiles: one Spark job each,
whose tiles of all pairs run side by side and hand on two short edges a tile.

A path of at most ``k`` edits leaves the band around the main diagonal by no more than
``(k - gap) / 2``, ``gap`` being the difference of the lengths. Tiles outside are left out, and an edge
that comes from outside rises by one a step, which is never below the truth. So a
result of at most ``k`` is exact; the other pairs go again with a band four times as wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from segmill.session import checkpointed

#: Symbols along an edge of a tile.
TILE = 65_536
#: A symbol found more often than this keeps its bit vector; others build theirs from their positions.
_OFTEN = 32
_KINDS = ("words", "chars")


def _vectors(symbols):
    """A function from a symbol to the bit vector of its positions."""
    positions: dict = {}
    for at, symbol in enumerate(symbols):
        positions.setdefault(symbol, []).append(at)
    kept = {}
    for symbol, places in positions.items():
        if len(places) > _OFTEN:
            bits = bytearray(len(symbols) // 8 + 1)
            for at in places:
                bits[at >> 3] |= 1 << (at & 7)
            kept[symbol] = int.from_bytes(bits, "little")

    def vector(symbol) -> int:
        if symbol in kept:
            return kept[symbol]
        return sum(1 << at for at in positions.get(symbol, ()))

    return vector


def _tile(left, upper, rises: int, falls: int, top: bytes | None):
    """Cross one tile: the right edge's rises and falls, and the lower edge's steps (a byte each: step + 1)."""
    size = len(left)
    mask, last = (1 << size) - 1, size - 1
    vector, bottom = _vectors(left), bytearray(len(upper))
    for at, symbol in enumerate(upper):
        step = 1 if top is None else top[at] - 1
        equal = vector(symbol)
        across = equal | falls
        if step < 0:
            equal |= 1
        down = ((((equal & rises) + rises) ^ rises) | equal) & mask
        up = falls | (mask ^ (down | rises))
        less = rises & down
        bottom[at] = 1 + (up >> last) - (less >> last)
        up = (up << 1 | (step > 0)) & mask
        less = (less << 1 | (step < 0)) & mask
        rises = less | (mask ^ (across | up))
        falls = up & across
    return rises, falls, bytes(bottom)


def _symbols(text: str, kind: str):
    return (text.split(" ") if text else []) if kind == "words" else text


def _distance(left, upper) -> int:
    if not left or not upper:
        return max(len(left), len(upper))
    steps = _tile(left, upper, (1 << len(left)) - 1, 0, None)[2]
    return len(left) + sum(steps) - len(steps)


@F.pandas_udf(StructType([StructField("word_edits", IntegerType()), StructField("char_edits", IntegerType())]))
def _small(reference: pd.Series, hypothesis: pd.Series, tile: pd.Series) -> pd.DataFrame:
    """Both distances of pairs that are one tile; nothing for the other pairs."""
    made = []
    for left, upper, size in zip(reference, hypothesis, tile):
        row = (None, None)
        if left is not None and upper is not None:
            sides = [_symbols(left, "words"), _symbols(upper, "words")], [left.replace(" ", ""), upper.replace(" ", "")]
            row = [_distance(*pair) if max(map(len, pair)) <= size else None for pair in sides]
        made.append(row)
    return pd.DataFrame(made, columns=["word_edits", "char_edits"]).astype("Int32")


_EDGES = (
    "pair long, kind string, rows int, cols int, low long, high long, i int, j int, "
    "corner long, rises binary, falls binary, top binary, edits long"
)


def _advance(tile: int):
    """Cross the tiles of one anti-diagonal; a row is an edge for a neighbour, or the pair's distance."""

    def inside(row, i: int, j: int) -> bool:
        return i < row.rows and j < row.cols and (j - i - 1) * tile < row.high + 1 and (j - i + 1) * tile > row.low - 1

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                left, upper = _symbols(row.left, row.kind), _symbols(row.upper, row.kind)
                size, corner = len(left), int(row.corner)
                rises = (1 << size) - 1 if row.rises is None else int.from_bytes(row.rises, "little")
                falls = 0 if row.falls is None else int.from_bytes(row.falls, "little")
                top_right = corner + (len(upper) if row.top is None else sum(row.top) - len(upper))
                bottom_left = corner + rises.bit_count() - falls.bit_count()
                right, drop, bottom = _tile(left, upper, rises, falls, row.top)
                pair = (row.pair, row.kind, row.rows, row.cols, row.low, row.high)
                made = []
                if inside(row, row.i, row.j + 1):
                    width = size // 8 + 1
                    made.append((*pair, row.i, row.j + 1, top_right, right.to_bytes(width, "little"), drop.to_bytes(width, "little"), None, None))
                if inside(row, row.i + 1, row.j):
                    made.append((*pair, row.i + 1, row.j, bottom_left, None, None, bottom, None))
                if (row.i + 1, row.j + 1) == (row.rows, row.cols):
                    made.append((*pair, None, None, None, None, None, None, bottom_left + sum(bottom) - len(bottom)))
                out = pd.DataFrame(made, columns=[c.split()[0] for c in _EDGES.split(", ")])
                yield out.astype({"i": "Int32", "j": "Int32", "corner": "Int64", "edits": "Int64"})

    return cross


def _slices(rows: DataFrame, side: str, tile: int) -> DataFrame:
    """``pair, kind, block, text`` of one side's words and characters, ``tile`` symbols a row."""
    words, chars = F.split(side, " "), F.replace(F.col(side), F.lit(" "), F.lit(""))
    blocks = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(size / tile).cast("int") - 1))
    start = F.col("block") * tile + 1
    of_words = rows.select("pair", side, blocks(F.size(words)).alias("block")).select(
        "pair", F.lit("words").alias("kind"), "block", F.array_join(F.slice(words, start, tile), " ").alias("text")
    )
    of_chars = rows.select("pair", chars.alias("chars"), blocks(F.length(chars)).alias("block")).select(
        "pair", F.lit("chars").alias("kind"), "block", F.substr("chars", start, F.lit(tile)).alias("text")
    )
    return of_words.unionByName(of_chars)


def _long(rows: DataFrame, tile: int) -> DataFrame:
    """``pair, kind, edits`` of pairs ``pair, reference, hypothesis`` whose sides both hold words."""
    left = checkpointed(_slices(rows, "reference", tile).select("pair", "kind", F.col("block").alias("i"), F.col("text").alias("left")))
    upper = checkpointed(_slices(rows, "hypothesis", tile).select("pair", "kind", F.col("block").alias("j"), F.col("text").alias("upper")))
    size = lambda side, kind: F.size(F.split(side, " ")) if kind == "words" else F.length(F.replace(F.col(side), F.lit(" "), F.lit("")))
    sized = [
        rows.select("pair", F.lit(kind).alias("kind"), size("reference", kind).cast("long").alias("m"), size("hypothesis", kind).cast("long").alias("n"))
        for kind in _KINDS
    ]
    sizes = checkpointed(sized[0].unionByName(sized[1]))
    nothing = lambda kind: F.lit(None).cast(kind)
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    slack, found = tile, []
    while True:
        gap = F.col("n") - F.col("m")
        seeds = sizes.select(
            "pair", "kind", F.ceil(F.col("m") / tile).cast("int").alias("rows"), F.ceil(F.col("n") / tile).cast("int").alias("cols"),
            (F.least(F.lit(0), gap) - slack // 2).alias("low"), (F.greatest(F.lit(0), gap) + slack // 2).alias("high"),
            F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("corner"),
            nothing("binary").alias("rises"), nothing("binary").alias("falls"), nothing("binary").alias("top"), nothing("long").alias("edits"),
        )
        shape = seeds.agg(F.max(F.col("rows") + F.col("cols")), F.count("*")).first()
        spread = max(tasks, shape[1] // 32)
        edges = seeds
        for _ in range(shape[0] - 1):
            met = edges.where("edits IS NULL").groupBy("pair", "kind", "rows", "cols", "low", "high", "i", "j")
            tiles = met.agg(*[F.max(c).alias(c) for c in ("corner", "rises", "falls", "top")])
            tiles = tiles.join(left, ["pair", "kind", "i"]).join(upper, ["pair", "kind", "j"]).repartition(spread, "pair", "kind", "i")
            edges = checkpointed(tiles.mapInPandas(_advance(tile), _EDGES).unionByName(edges.where("edits IS NOT NULL")))
        judged = sizes.join(edges.select("pair", "kind", "rows", "cols", "edits"), ["pair", "kind"])
        whole = F.lit(slack // 2) >= F.greatest("m", "n")
        exact = (F.col("edits") <= F.abs(gap) + slack) | whole
        found.append(judged.where(exact).select("pair", "kind", "edits"))
        sizes = checkpointed(judged.where(~exact).select("pair", "kind", "m", "n"))
        if sizes.isEmpty():
            break
        slack *= 4
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    return done


def with_edits(pairs: DataFrame, reference: Column, hypothesis: Column, tile: int = TILE) -> DataFrame:
    """``pairs`` with ``word_edits`` and ``char_edits``.

    ``reference`` and ``hypothesis`` are words joined by single spaces (empty: no word); a null
    gives nulls. Characters are those of the words alone. Each row of ``pairs`` is one pair,
    repeated rows included; other columns are carried.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pairs.columns])
    kept = pairs.select(row.alias("row"), reference.alias("reference"), hypothesis.alias("hypothesis"))
    kept = kept.withColumn("small", _small("reference", "hypothesis", F.lit(tile)))
    size = lambda side: F.greatest(F.length(F.replace(F.col(side), F.lit(" "), F.lit(""))), F.size(F.split(side, " ")))
    big = F.coalesce(F.greatest(size("reference"), size("hypothesis")) > tile, F.lit(False))
    text = lambda side: F.when(F.col("big"), F.col(side)).alias(side)
    kept = kept.withColumn("big", big).select("row", text("reference"), text("hypothesis"), "small", "big", F.monotonically_increasing_id().alias("pair"))
    kept = checkpointed(kept)
    # A side without words takes the other side's length, so only two sides with words have tiles.
    both = kept.where("big AND reference != '' AND hypothesis != ''")
    edits = [F.col("small.word_edits"), F.col("small.char_edits")]
    if not both.isEmpty():
        long = _long(both.select("pair", "reference", "hypothesis"), tile)
        flat = long.groupBy("pair").agg(*[F.max(F.when(F.col("kind") == kind, F.col("edits"))).cast("int").alias(kind) for kind in _KINDS])
        kept = kept.join(checkpointed(flat), "pair", "left")
        edits = [F.coalesce("words", edits[0]), F.coalesce("chars", edits[1])]
    alone = F.concat("reference", "hypothesis")
    lone = F.col("big") & ((F.col("reference") == "") | (F.col("hypothesis") == ""))
    counts = [F.size(F.split(alone, " ")), F.length(F.replace(alone, F.lit(" "), F.lit("")))]
    return kept.select("row.*", *[F.when(lone, count).otherwise(edit).alias(name) for name, edit, count in zip(("word_edits", "char_edits"), edits, counts)])
