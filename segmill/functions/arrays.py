"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once.

    A computed column used inside a lambda is otherwise inlined into it by the
    optimizer and evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
