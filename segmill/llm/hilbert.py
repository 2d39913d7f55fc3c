"""Sharding along a Hilbert curve over metadata, for files that prune in several dimensions.

Every dimension is quantised to ``2**BITS`` bands at its own quantiles; the
bands are a cell, the Hilbert index of the cell its place on the curve, and the
rows in order of the curve are cut into runs. Only numbers per (cell, part)
are summed in one place; rows are ranked inside their own (cell, part), so a
cell that holds most of the rows is still spread over ``PARTS`` groups.

Defined results: a null dimension falls into the lowest band, a null text has
no bytes. Repeated rows keep a place each; equal ones may change places. An
empty table gives an empty result. Other columns are carried; the operator's own
are ``shard`` and ``slot``, which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.session import checkpointed

#: Bands per dimension as a power of two; three dimensions give at most 32,768 cells.
BITS = 5
#: Groups that the rows of one cell are ranked in.
PARTS = 256


def with_rank(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: in how many rows ``text`` comes before this row's one (null for null), exact for texts of any length.

    The distinct texts are counted, dealt by range and written with their part, so a part's
    texts are ranked in one task each and only the parts' sums meet in one place.
    """
    counted = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_rows"))
    dealt = counted.repartitionByRange("_text").select("_text", "_rows", F.spark_partition_id().alias("_deal"))
    dealt = checkpointed(dealt)
    inside = Window.partitionBy("_deal").orderBy("_text").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_deal").agg(F.sum("_rows").alias("_rows"))
    before = Window.orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("_deal", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.join(parts, "_deal").select(
        "_text", (F.col("_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).cast("double").alias(name)
    )
    ranked = checkpointed(ranked)  # written, so Spark knows its size before it joins
    return df.drop(name).join(ranked, F.col(text) == F.col("_text"), "left").drop("_text")


def bands(df: DataFrame, dimensions: list[str], bits: int = BITS) -> list[Column]:
    """For each numeric column, in how many of its quantiles a value lies above; null is 0."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(str(k)) for k, x in enumerate(dimensions)]).first()
    out = []
    for name, cuts in zip(dimensions, found, strict=True):
        above = [F.when(F.col(name) > cut, 1).otherwise(0) for cut in sorted(set(cuts or ()))]
        out.append(sum(above, F.lit(0)))
    return out


def hilbert_index(axes: list[str], bits: int = BITS) -> Column:
    """The index of a cell (columns of band numbers) on the Hilbert curve: axes to transposed index, Gray code, bits interleaved."""
    n = len(axes)
    pairs = ", ".join(f"struct({1 << q} AS q, {i} AS i)" for q in range(bits - 1, 0, -1) for i in range(n))
    turned = f"""aggregate(array({pairs}), x0, (a, s) -> transform(a, (x, k) ->
        CASE WHEN a[s.i] & s.q <> 0 THEN IF(k = 0, x ^ (s.q - 1), x)
             WHEN k = 0 OR k = s.i THEN x ^ ((a[0] ^ a[s.i]) & (s.q - 1)) ELSE x END))"""
    gray = "transform(x1, (x, k) -> aggregate(slice(x1, 1, k + 1), 0, (u, v) -> u ^ v))"
    steps = ", ".join(str(1 << q) for q in range(bits - 1, 0, -1))
    flip = f"aggregate(array({steps}), 0, (t, q) -> IF(x2[{n - 1}] & q <> 0, t ^ (q - 1), t))"
    woven = f"""aggregate(sequence({bits - 1}, 0, -1), 0, (w, b) ->
        aggregate(x2, w, (u, v) -> shiftleft(u, 1) | (shiftright(v ^ x3, b) & 1)))"""
    inner = _let("x3", flip, woven)
    whole = _let("x0", f"array({', '.join(axes)})", _let("x1", turned, _let("x2", gray, inner)))
    return F.expr(whole)


def _let(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def hilbert_shards(df: DataFrame, dimensions: list[str], shards: int, order: list[str], size: str, law: str = "rows") -> DataFrame:
    """Add ``shard`` and ``slot``: runs of the rows in order of the curve.

    Law ``rows`` cuts runs whose counts differ by at most one; law ``bytes``
    cuts where the sum of ``size`` passes the next ``1 / shards`` of the total.
    ``order`` names the columns that rank rows of one cell. ``df`` is read more
    than once and should be narrow and written.
    """
    df = df.drop("shard", "slot")
    axes = bands(df, dimensions)
    names = [f"_axis{k}" for k in range(len(axes))]
    named = df.withColumns(dict(zip(names, axes, strict=True)))
    named = named.withColumn("_cell", hilbert_index(names)).drop(*names)
    named = named.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    named = named.withColumn("_weight", F.lit(1).cast("long") if law == "rows" else F.col(size).cast("long"))

    groups = checkpointed(named.groupBy("_cell", "_part").agg(F.count("*").alias("_rows"), F.sum("_weight").alias("_sum")))
    cells = groups.groupBy("_cell").agg(F.sum("_rows").alias("_rows"), F.sum("_sum").alias("_sum"))
    curve = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** (BITS * dimensions) rows
    inside = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = cells.agg(F.sum("_sum")).first()[0] or 1

    def earlier(column: str, over) -> Column:
        return F.coalesce(F.sum(column).over(over), F.lit(0))

    cells = cells.select("_cell", earlier("_rows", curve).alias("_rows0"), earlier("_sum", curve).alias("_sum0"))
    groups = groups.select("_cell", "_part", earlier("_rows", inside).alias("_rows1"), earlier("_sum", inside).alias("_sum1"))
    starts = groups.join(cells, "_cell").select(
        "_cell", "_part", (F.col("_rows0") + F.col("_rows1")).alias("_rows0"), (F.col("_sum0") + F.col("_sum1")).alias("_sum0")
    )
    within = Window.partitionBy("_cell", "_part").orderBy(*order)
    ranked = named.withColumns(
        {
            "_rank": F.row_number().over(within) - 1,
            "_run": earlier("_weight", within.rowsBetween(Window.unboundedPreceding, -1)),
        }
    ).join(starts, ["_cell", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_rows0"))
    ranked = ranked.withColumn(
        "shard", F.expr(f"CAST(least({shards - 1}, (_run + _sum0) * {shards} div {total}) AS INT)")
    )
    kept = [*df.columns, "shard", "_rank"]
    ranked = checkpointed(ranked.select(*kept))
    firsts = ranked.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    return ranked.join(F.broadcast(firsts), "shard").select(*df.columns, "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
