"""first / last by a key, and histogram, as built-in aggregates (partial before the shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(value: Column, key: Column) -> Column:
    """The value at the smallest key. Rows without a key don't count; a null value at that key is null; ties are open."""
    return F.min_by(value, key)


def last(value: Column, key: Column) -> Column:
    return F.max_by(value, key)


def histogram(value: Column, low: float, high: float, buckets: int) -> Column:
    """array<int> of buckets + 2 counts: below low, the buckets, at or over high. Nulls are ignored; no rows give null."""
    if low > high:
        raise ValueError("lower bound cannot exceed upper bound")
    if buckets < 1:
        raise ValueError("number of buckets must be positive")
    place = F.when(value < low, 0).when(value >= high, buckets + 1).when(value.isNotNull(), F.least(F.floor((value - low) * buckets / (high - low)) + 1, F.lit(buckets)))
    return F.when(F.count("*") > 0, F.array(*[F.count_if(place == i).cast("int") for i in range(buckets + 2)]))
