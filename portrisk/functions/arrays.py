"""Small fixed-length vector helpers over array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(array: Column, n: int) -> list[Column]:
    return [array.getItem(i) for i in range(n)]


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def one_hot(index: Column, k: int) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in range(k)]), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def lower_bound(bounds: Column, value: Column, steps: int) -> Column:
    """Number of entries of a sorted array of at most 2**steps - 1 values that are < value.

    A branch-free binary search: log2(size) probes per row, no explode, no join. A probe beyond the end is null.
    """
    strides = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(
        strides,
        F.lit(0),
        lambda pos, s: F.when(F.get(bounds, pos + s - 1) < value, pos + s).otherwise(pos),
    )
