"""Intervals as (months, days, micros) and internal time (epoch microseconds or integers)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Monday 2000-01-03 for day and time widths; 2000-01 for month widths.
ORIGIN = 946_857_600_000_000
ORIGIN_MONTH = 2000 * 12
_UNITS = {"microsecond": (0, 0, 1), "millisecond": (0, 0, 1000), "second": (0, 0, 10**6), "minute": (0, 0, 60 * 10**6), "hour": (0, 0, 3600 * 10**6), "day": (0, 1, 0), "week": (0, 7, 0), "month": (1, 0, 0), "year": (12, 0, 0)}
_SHORT = {"us": "microsecond", "ms": "millisecond", "sec": "second", "s": "second", "min": "minute", "m": "minute", "h": "hour", "d": "day", "w": "week", "mon": "month", "y": "year"}


@dataclass(frozen=True)
class Interval:
    months: int = 0
    days: int = 0
    micros: int = 0

    @property
    def fixed(self) -> bool:
        return not self.months

    def width(self) -> int:
        """Microseconds of a fixed width."""
        if self.months and (self.days or self.micros):
            raise ValueError("month intervals cannot have day or time component")
        if self.months:
            raise ValueError("a month width has no fixed length")
        return self.days * DAY + self.micros

    def __neg__(self) -> Interval:
        return Interval(-self.months, -self.days, -self.micros)


def interval(value: str | Interval | timedelta) -> Interval:
    """Parse '1 month', '1 day 02:00', '15 min', ..."""
    if isinstance(value, Interval):
        return value
    if isinstance(value, timedelta):
        return Interval(0, value.days, value.seconds * 10**6 + value.microseconds)
    months = days = micros = 0
    rest = value.strip().lower()
    for n, unit in re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", rest):
        unit = _SHORT.get(unit, unit.rstrip("s") if unit.rstrip("s") in _UNITS else unit)
        unit = _SHORT.get(unit, unit)
        if unit not in _UNITS:
            raise ValueError(f"unknown interval unit {unit!r}")
        m, d, u = _UNITS[unit]
        x = float(n)
        months, days, micros = months + round(x * m), days + round(x * d) if d else days, micros + round(x * u)
    if clock := re.search(r"([+-]?)(\d+):(\d{2})(?::(\d{2})(?:\.(\d+))?)?", rest):
        t = ((int(clock[2]) * 60 + int(clock[3])) * 60 + int(clock[4] or 0)) * 10**6 + int((clock[5] or "0").ljust(6, "0")[:6])
        micros += -t if clock[1] == "-" else t
    if not re.search(r"\d", rest):
        raise ValueError(f"not an interval: {value!r}")
    return Interval(months, days, micros)


def micros_of(t: datetime | date) -> int:
    if not isinstance(t, datetime):
        t = datetime(t.year, t.month, t.day)
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def time_of(micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def internal(c: Column, kind: str) -> Column:
    """A time column as epoch microseconds; integers as bigint. kind: timestamp, timestamp_ntz, date, int."""
    return c.cast("bigint") if kind == "int" else F.unix_micros(c.cast("timestamp"))


def external(c: Column, kind: str) -> Column:
    return c if kind == "int" else F.timestamp_micros(c).cast(kind)


def kind_of(type_name: str) -> str:
    return {"timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "date": "date"}.get(type_name, "int")
