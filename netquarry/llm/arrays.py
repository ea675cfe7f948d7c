"""Prefix sums and running extremes inside an array, in built-in functions and O(n log n) steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doublings: enough for arrays of 2^30 elements, more than a row can hold.
_DOUBLINGS = 30


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """At each place, all values up to it combined (an associative operation): each doubling takes in the place as far back again."""

    def doubled(a: Column, step: Column) -> Column:
        shifted = F.concat(F.array_repeat(neutral, step), F.slice(a, F.lit(1), F.size(a) - step))
        return F.when(F.size(a) > step, F.zip_with(a, shifted, combine)).otherwise(a)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(_DOUBLINGS)]), values, doubled)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0).cast("long"))
