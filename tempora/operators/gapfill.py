"""Gap filling: bucket aggregates with every bucket of a range present, locf and interpolate.

The rows to add are made from the groups and a sequence of bucket starts, and
joined to the aggregate; nothing is made from raw rows. Fills are window
functions over a group, each partition sorted once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import bucket_value, next_bucket, time_bucket
from ..functions.timeutil import interval, micros_of


@dataclass
class Fill:
    """How one aggregate is filled: kind 'none', 'locf' or 'interpolate'; prev and next as in the range's ends."""

    kind: str = "none"
    null_is_missing: bool = False
    prev: Column | None = None
    next: Column | None = None


@dataclass
class Gapfill:
    width: object
    time: str
    start: object
    finish: object
    keys: list[str] = field(default_factory=list)
    timezone: str | None = None


def bounds(predicates: list[tuple[str, object]], unit):
    """start and finish from comparisons of the time column with constants: (op, value) pairs; > and <= move by one unit."""
    low = [v + unit if op == ">" else v for op, v in predicates if op in (">", ">=")]
    high = [v + unit if op == "<=" else v for op, v in predicates if op in ("<", "<=")]
    if not low or not high:
        raise ValueError("missing start or finish: could not infer from the predicates")
    return max(low), min(high)


def gapfill(df: DataFrame, spec: Gapfill, aggregates: dict[str, Column], fills: dict[str, Fill] | None = None, name: str = "bucket") -> DataFrame:
    """Aggregate df by bucket and keys and add the missing buckets of [start, finish)."""
    fills, keys = fills or {}, spec.keys
    whole = isinstance(spec.start, int)
    kind = df.schema[spec.time].dataType.typeName()
    if whole:
        c = F.col(spec.time).cast("bigint")
        real = c - F.pmod(c, F.lit(spec.width))
        series = F.sequence(F.lit(bucket_value(spec.width, spec.start)), F.lit(spec.finish - 1), F.lit(spec.width)) if spec.finish > bucket_value(spec.width, spec.start) else F.array().cast("array<bigint>")
        series = series.cast("array<bigint>")
    else:
        real = time_bucket(spec.width, F.col(spec.time), kind, timezone=spec.timezone)
        starts, at = [], bucket_value(spec.width, spec.start)
        if spec.timezone is None and interval(spec.width).fixed and at < spec.finish:
            w = interval(spec.width).width()
            micros = F.sequence(F.lit(micros_of(at)), F.lit(micros_of(spec.finish) - 1), F.lit(w))
            series = F.transform(micros, lambda x: F.timestamp_micros(x).cast(kind))
        else:
            while at < spec.finish:
                starts.append(at)
                at = next_bucket(spec.width, at)
            series = F.array(*[F.lit(x).cast("timestamp") for x in starts])
            if spec.timezone:
                series = F.transform(series, lambda x: F.to_utc_timestamp(x, spec.timezone))
            series = F.transform(series, lambda x: x.cast(kind))
    rows = df.groupBy(real.alias(name), *keys).agg(*[a.alias(n) for n, a in aggregates.items()]).withColumn("_real", F.lit(True))
    spark = df.sparkSession
    groups = rows.select(*keys).distinct() if keys else spark.range(1).select()
    grid = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.explode(series).alias("_g_bucket"))
    condition = F.col("_g_bucket") == F.col(name)
    for k in keys:
        condition = condition & F.col(f"_g_{k}").eqNullSafe(F.col(k))
    out = grid.join(rows, condition, "full").select(
        F.coalesce("_g_bucket", name).alias(name),
        *[F.when(F.col("_real").isNull(), F.col(f"_g_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        *aggregates,
        F.coalesce("_real", F.lit(False)).alias("_real"),
    )
    order = Window.partitionBy(*keys).orderBy(name) if keys else Window.partitionBy(F.lit(0)).orderBy(name)
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    # what follows a row is what precedes it in falling order; a frame from the row to the end would be read anew for each row
    after = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(name).cast("bigint") if whole else F.unix_micros(F.col(name).cast("timestamp"))
    for n, fill in fills.items():
        value = F.col(n)
        if fill.kind == "locf":
            seen = F.when(F.col("_real") & (value.isNotNull() if fill.null_is_missing else F.lit(True)), F.struct(value.alias("v")))
            carried = F.last(seen, True).over(before)
            filled = carried["v"] if fill.prev is None else F.when(carried.isNull(), fill.prev).otherwise(carried["v"])
            keep = F.col("_real") & value.isNotNull() if fill.null_is_missing else F.col("_real")
            out = out.withColumn(n, F.when(keep, value).otherwise(filled))
        elif fill.kind == "interpolate":
            point = F.when(F.col("_real"), F.struct(x.alias("x"), value.alias("y")))
            a, b = F.last(point, True).over(before), F.last(point, True).over(after)
            if fill.prev is not None:
                a = F.coalesce(a, fill.prev)
            if fill.next is not None:
                b = F.coalesce(b, fill.next)
            y = (a["y"] * (b["x"] - x) + b["y"] * (x - a["x"])) / (b["x"] - a["x"])
            kind_y = out.schema[n].dataType.typeName()
            y = F.round(y).cast(kind_y) if kind_y in ("byte", "short", "integer", "long") else F.when(a["y"] == b["y"], a["y"]).otherwise(y)
            out = out.withColumn(n, F.when(F.col("_real"), value).otherwise(y))
    return out.drop("_real")


