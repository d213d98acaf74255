"""UUIDv7 values as 36-character strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .buckets import time_bucket


def version(u: Column) -> Column:
    """The version, or null for other variants."""
    variant = F.substring(u, 20, 1)
    return F.when(variant.isin(*"89abAB"), F.conv(F.substring(u, 15, 1), 16, 10).cast("int"))


def _millis(u: Column) -> Column:
    return F.conv(F.concat(F.substring(u, 1, 8), F.substring(u, 10, 4)), 16, 10).cast("bigint")


def timestamp(u: Column, micros: bool = False) -> Column:
    """The embedded time; null if not version 7."""
    t = _millis(u) * 1000
    if micros:
        t = t + F.floor((F.conv(F.substring(u, 16, 3), 16, 10).cast("bigint") + 1) * 1000 / 4096)
    return F.when(version(u) == 7, F.timestamp_micros(t))


def _build(ts: Column, tail: Column, variant: Column) -> Column:
    u = F.unix_micros(ts.cast("timestamp"))
    ms = F.lpad(F.lower(F.hex(F.floor(u / 1000))), 12, "0")
    sub = F.lpad(F.lower(F.hex(F.floor(F.pmod(u, F.lit(1000)) * 4096 / 1000))), 3, "0")
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), sub, F.lit("-"), variant, F.substring(tail, 1, 3), F.lit("-"), F.substring(tail, 4, 12))


def to_uuidv7(ts: Column) -> Column:
    """A version 7 value of the time with random tail."""
    tail = F.lower(F.concat(F.substring(F.md5(F.rand().cast("string")), 1, 15)))
    return _build(ts, tail, F.lit("8"))


def to_uuidv7_boundary(ts: Column) -> Column:
    """The smallest version 7 value of the time."""
    return _build(ts, F.lit("0" * 15), F.lit("8"))


def generate_uuidv7() -> Column:
    return to_uuidv7(F.current_timestamp())


def bucket(width, u: Column) -> Column:
    """time_bucket over the embedded time; a value that is not version 7 is an error, null stays null."""
    t = timestamp(u)
    return F.when(u.isNotNull() & t.isNull(), F.raise_error(F.concat(F.lit("not a version 7 UUID: "), u)).cast("timestamp")).otherwise(time_bucket(width, t))
