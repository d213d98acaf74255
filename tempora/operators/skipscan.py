"""The newest row of each group (DISTINCT ON) as one partial aggregate: nothing is sorted, and a group sends a row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str], oldest: bool = False) -> DataFrame:
    """For each value of keys, its row with the largest (or smallest) order columns. Rows whose first order column is null don't count."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if oldest else F.max_by
    rank: Column = F.struct(*order)
    found = df.where(F.col(order[0]).isNotNull()).groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
