"""Running values over ordered rows of a key, safe when one key holds most rows.

A window partitioned by the recording would put the whole recording into one
task. Here the rows of a key are cut into position chunks: the window runs inside
``(key, chunk)`` and what earlier chunks contribute arrives as one small row per
chunk. Both the window and the join partition by ``(key, chunk)``, so the large
side moves once. Chunks of dense positions are few: what they contribute goes to
all tasks, and rows that lie by their key already do not move at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, max or last (last non-null); ``inclusive`` counts the row itself."""

    kind: str
    value: Column
    inclusive: bool = True


def position_chunk(position: str, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(position) / F.lit(rows)).cast("bigint")


def with_running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: dict[str, Running],
    dense: bool = False,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add one column per entry of ``values``, and the ``_chunk`` if it is to be kept.

    ``order`` must be a total order inside a key and ``chunk`` must not decrease
    along it. ``dense``: a key's chunks but the last hold about ``CHUNK_ROWS`` rows,
    as ``position_chunk`` of a row number makes them.
    """
    key, order = list(key), list(order)
    cut = [*key, "_chunk"]
    rows = df.withColumn("_chunk", chunk)
    rows = rows.withColumns({f"_v_{name}": spec.value for name, spec in values.items()})

    position = [F.col(c) for c in order]

    def total(name: str, kind: str) -> Column:
        value = F.col(f"_v_{name}")
        if kind == "sum":
            return F.sum(value)
        if kind == "max":
            return F.max(value)
        return F.max(F.when(value.isNotNull(), F.struct(*position, value.alias("_value"))))

    totals = rows.groupBy(*cut).agg(*[total(n, s.kind).alias(f"_t_{n}") for n, s in values.items()])
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *cut,
        *[
            (F.sum if s.kind == "sum" else F.max)(f"_t_{n}").over(earlier).alias(f"_c_{n}")
            for n, s in values.items()
        ],
    )

    if dense:
        # A key's first chunk, for most keys the only one, is carried nothing.
        some = reduce(or_, (F.col(f"_c_{name}").isNotNull() for name in values))
        carried = F.broadcast(carried.filter(some))
    joined = rows.join(carried, cut, "left")
    within = Window.partitionBy(*cut).orderBy(*order)
    result = {}
    for name, spec in values.items():
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        value, carry = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if spec.kind == "sum":
            result[name] = F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif spec.kind == "max":
            result[name] = F.greatest(F.max(value).over(frame), carry)
        else:
            local = F.last(value, ignorenulls=True).over(frame)
            result[name] = F.coalesce(local, carry.getField("_value"))
    drop = ([] if keep_chunk else ["_chunk"]) + [f"_{p}_{n}" for n in values for p in "vc"]
    return joined.withColumns(result).drop(*drop)
