"""time_bucket as Column expressions, with twin functions for the driver. Session time zone: UTC."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeutil import DAY, ORIGIN, ORIGIN_MONTH, Interval, interval, micros_of, time_of


def bucket_int(width: int, c: Column, offset: int = 0) -> Column:
    """Floor to a multiple of width from offset; negative values floor too."""
    if width <= 0:
        raise ValueError("period must be greater than 0")
    offset = offset - int(offset / width) * width
    w, o = F.lit(width).cast("bigint"), F.lit(offset).cast("bigint")
    return c - F.pmod(c - o, w)


def _shift(c: Column, by: Interval) -> Column:
    if by.months:
        c = F.timestamp_add("MONTH", F.lit(by.months), c)
    return F.timestamp_micros(F.unix_micros(c) + F.lit(by.days * DAY + by.micros)) if by.days or by.micros else c


def _fixed(width: Interval, c: Column, origin: int) -> Column:
    w = width.width()
    if w <= 0:
        raise ValueError("period must be greater than 0")
    u = F.unix_micros(c)
    return F.timestamp_micros(u - F.pmod(u - F.lit(origin).cast("bigint"), F.lit(w).cast("bigint")))


def _months(n: int, c: Column, origin: int) -> Column:
    if n <= 0:
        raise ValueError("period must be greater than 0")
    m = F.year(c) * 12 + F.month(c) - 1
    b = m - F.pmod(m - F.lit(origin), F.lit(n))
    return F.make_date(F.floor(b / 12).cast("int"), (F.pmod(b, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")


def time_bucket(width: str | Interval, c: Column, kind: str = "timestamp", origin: datetime | date | None = None, offset: str | Interval | None = None, timezone: str | None = None) -> Column:
    """Start of c's bucket as `kind` (timestamp, timestamp_ntz or date)."""
    w = interval(width)
    if w.months and (w.days or w.micros):
        raise ValueError("month intervals cannot have day or time component")
    by = interval(offset) if offset is not None else None
    if kind == "date":
        for x in (w, by or Interval()):
            if x.micros % DAY:
                raise ValueError("interval must be a whole number of days for dates")
    ts = c.cast("timestamp")
    if by:
        ts = _shift(ts, -by)
    if w.months:
        month = origin.year * 12 + origin.month - 1 if origin else ORIGIN_MONTH
        bucket = lambda x: _months(w.months, x, month)
    else:
        bucket = lambda x: _fixed(w, x, micros_of(origin) if origin else ORIGIN)
    out = bucket(ts)
    if timezone:
        local = bucket(F.from_utc_timestamp(ts, timezone))
        first = F.to_utc_timestamp(local, timezone)
        hour, half = (F.timestamp_micros(F.unix_micros(first) + F.lit(x)) for x in (3_600_000_000, 1_800_000_000))
        # of two instants with the same local time, the later one
        out = F.when(F.from_utc_timestamp(hour, timezone) == local, hour).when(F.from_utc_timestamp(half, timezone) == local, half).otherwise(first)
        if w.fixed:
            n = F.ceil(F.greatest(F.unix_micros(out) - F.unix_micros(ts), F.lit(0)) / F.lit(w.width())).cast("bigint")
            out = F.timestamp_micros(F.unix_micros(out) - n * F.lit(w.width()))
    if by:
        out = _shift(out, by)
    return out.cast(kind)


def bucket_value(width, t, origin=None):
    """The driver's twin of time_bucket without zone and offset: int or datetime in, the same out."""
    if isinstance(t, int):
        return t - (t - (origin or 0)) % width
    w = interval(width)
    if w.months:
        first = origin.year * 12 + origin.month - 1 if origin else ORIGIN_MONTH
        m = t.year * 12 + t.month - 1
        m -= (m - first) % w.months
        return datetime(m // 12, m % 12 + 1, 1)
    u = micros_of(t)
    return time_of(u - (u - (micros_of(origin) if origin else ORIGIN)) % w.width())


def next_bucket(width, start):
    """The start after a bucket start."""
    if isinstance(start, int):
        return start + width
    w = interval(width)
    if w.months:
        m = start.year * 12 + start.month - 1 + w.months
        return datetime(m // 12, m % 12 + 1, 1)
    return time_of(micros_of(start) + w.width())


def align_to_bucket(width, low, high):
    """The smallest range of whole buckets that holds [low, high)."""
    start = bucket_value(width, low)
    end = bucket_value(width, high)
    return start, end if end == high else next_bucket(width, end)


def bucket_range(op: str, width, value, origin=None):
    """Bounds (low inclusive, high exclusive) on the raw column implied by `time_bucket(width, c) op value`; None is open."""
    f = bucket_value(width, value, origin)
    n = next_bucket(width, f)
    if op == "=":
        return (f, n) if f == value else (n, n)
    return {">=": (value if f == value else n, None), ">": (n, None), "<": (None, value if f == value else n), "<=": (None, n)}[op]
