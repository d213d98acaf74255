"""Continuous aggregates: materialised bucket aggregates refreshed by ranges of change.

State: the watermark (end of the last bucket that has rows), the position in the
source's change log, and pending ranges, which at first are all of time. A
refresh takes the whole buckets inside its window, raises the source's threshold
to the window's end (changes above it need no log), cuts the pending ranges by
the window and recomputes only those buckets. The real-time view is the
materialisation below the watermark and a fresh aggregate of rows from it on.
A source is a table or another continuous aggregate.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import timezone as utc_zone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_int, bucket_value, next_bucket, time_bucket
from ..functions.timeutil import interval, internal, kind_of, micros_of, time_of
from ..sources.hypertable import Hypertable

LOWEST, HIGHEST = -(1 << 62), 1 << 62
#: Seconds after which a refresh that left its window registered counts as dead.
STALE = 3600


def merge_ranges(ranges: list) -> list[list[int]]:
    """Union of inclusive ranges; ranges that touch join."""
    out: list[list[int]] = []
    for a, b in sorted(map(list, ranges)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_ranges(ranges: list, low: int, high: int) -> tuple[list, list]:
    """(inside [low, high), outside)."""
    inside, outside = [], []
    for a, b in ranges:
        if a < low:
            outside.append([a, min(b, low - 1)])
        if b >= high:
            outside.append([max(a, high), b])
        if max(a, low) <= min(b, high - 1):
            inside.append([max(a, low), min(b, high - 1)])
    return inside, outside


@dataclass(frozen=True)
class Join:
    """An inner or left join of the source with a plain table, on columns or a condition."""

    table: DataFrame
    on: object
    how: str = "inner"


@dataclass
class Definition:
    width: object
    keys: list[str] = field(default_factory=list)
    aggregates: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None
    having: Column | None = None
    name: str = "bucket"
    materialized_only: bool = False
    joins: tuple[Join, ...] = ()
    timezone: str | None = None


class TableSource:
    """A table as the source of an aggregate."""

    def __init__(self, table: Hypertable):
        self.table, self.files, self.spark, self.schema, self.root = table, table.files, table.spark, table.schema, table.root
        self.column, self.kind = table.state["time"], table.state["kind"]
        self.raise_threshold = table.raise_threshold

    @property
    def changes(self) -> list:
        return self.table.state["changes"]

    def extent(self) -> tuple[int, int] | None:
        return self.table.extremes(self.column)

    def rows(self, low=None, high=None) -> DataFrame:
        return self.table.scan(low, high)

    settled = rows


class AggregateSource:
    """A continuous aggregate as the source of another: materialising reads what it has materialised."""

    def __init__(self, lower: ContinuousAggregate):
        self.lower, self.files, self.spark, self.root = lower, lower.files, lower.source.spark, lower.root
        self.column, self.kind, self.schema = lower.d.name, lower.source.kind, lower.schema

    @property
    def changes(self) -> list:
        return self.lower.state["log"]

    def raise_threshold(self, to: int) -> None:
        """The lower aggregate logs all that it recomputes."""

    def extent(self) -> tuple[int, int] | None:
        parts = self.lower.state["parts"]
        return (min(a for a, _, _ in parts), self.lower.state["watermark"] - 1) if parts and self.lower.state["watermark"] > LOWEST else None

    def _cut(self, df: DataFrame, low, high) -> DataFrame:
        for bound, test in ((low, lambda c, x: c >= F.lit(x)), (high, lambda c, x: c < F.lit(x))):
            if bound is not None:
                df = df.where(test(F.col(self.column), bound))
        return df

    def rows(self, low=None, high=None) -> DataFrame:
        return self._cut(self.lower.view(), low, high)

    def settled(self, low=None, high=None) -> DataFrame:
        return self._cut(self.lower.materialised(), low, high)


def nests(width, timezone, lower, lower_timezone) -> None:
    """Raise if buckets of one width aren't whole numbers of the lower aggregate's buckets."""
    wrong = ValueError("width must be a multiple of the lower aggregate's, in its time zone")
    if isinstance(width, int) or isinstance(lower, int):
        if not (isinstance(width, int) and isinstance(lower, int)) or width % lower:
            raise wrong
        return
    a, b = interval(width), interval(lower)
    if timezone != lower_timezone:
        raise wrong
    if b.months:
        if not a.months or a.months % b.months:  # no fixed width on a variable one
            raise wrong
    elif a.fixed and a.width() % b.width() or not a.fixed and 86_400_000_000 % b.width():
        raise wrong


class ContinuousAggregate:
    def __init__(self, table: Hypertable | ContinuousAggregate, root: str, definition: Definition):
        self.source = AggregateSource(table) if isinstance(table, ContinuousAggregate) else TableSource(table)
        self.table, self.root, self.d, self.files = table, root.rstrip("/"), definition, self.source.files
        self._validate()
        self.schema = self.aggregate(self.source.spark.createDataFrame([], self.source.schema)).schema
        self.version, self.state = self.files.newest(f"{self.root}/cagg")
        self.state = self.state or {"watermark": LOWEST, "seen": len(self.source.changes), "pending": [[LOWEST, HIGHEST]], "parts": [], "log": []}

    def _validate(self) -> None:
        d = self.d
        if not d.aggregates:
            raise ValueError("a continuous aggregate needs an aggregate")
        names = [d.name, *d.keys, *d.aggregates]
        if len(set(names)) < len(names):
            raise ValueError("columns of a continuous aggregate must differ in name")
        if (self.source.kind == "int") != isinstance(d.width, int):
            raise ValueError("an integer table needs an integer width, a time table an interval")
        if isinstance(d.width, int):
            if d.width <= 0 or d.timezone:
                raise ValueError("an integer width must be positive and has no time zone")
        else:
            w = interval(d.width)
            if w.months and (w.days or w.micros):
                raise ValueError("month intervals cannot have day or time component")
            if w.fixed and w.width() <= 0:
                raise ValueError("period must be greater than 0")
        for j in d.joins:
            if j.how not in ("inner", "left"):
                raise ValueError("only inner and left joins are possible in a continuous aggregate")
            if not isinstance(j.table, DataFrame):
                raise ValueError("exactly one table of a continuous aggregate may be a hypertable")
        if isinstance(self.source, AggregateSource):
            nests(d.width, d.timezone, self.source.lower.d.width, self.source.lower.d.timezone)

    def _save(self) -> None:
        self.files.commit(f"{self.root}/cagg", self.version + 1, self.state)
        self.version += 1

    # ---- buckets in internal time

    def _zoned(self, t: int):
        z = ZoneInfo(self.d.timezone)
        return time_of(t).replace(tzinfo=utc_zone.utc).astimezone(z).replace(tzinfo=None, fold=0)

    def _unzoned(self, local) -> int:
        """Of two instants with the same local time the later one; a local time that is skipped counts by the offset before."""
        return max(micros_of(local.replace(tzinfo=ZoneInfo(self.d.timezone), fold=fold).astimezone(utc_zone.utc)) for fold in (0, 1))

    def _floor(self, t: int) -> int:
        if self.source.kind == "int":
            return bucket_value(self.d.width, t)
        if self.d.timezone:
            return self._unzoned(bucket_value(self.d.width, self._zoned(t)))
        return micros_of(bucket_value(self.d.width, time_of(t)))

    def _next(self, t: int) -> int:
        if self.source.kind == "int":
            return t + self.d.width
        if self.d.timezone:
            return self._unzoned(next_bucket(self.d.width, self._zoned(t)))
        return micros_of(next_bucket(self.d.width, time_of(t)))

    def _outer(self, t):
        return t if self.source.kind == "int" else time_of(t)

    def _internal(self, v) -> int:
        return v if isinstance(v, int) else micros_of(v)

    def aggregate(self, df: DataFrame) -> DataFrame:
        kind, c = self.source.kind, F.col(self.source.column)
        kind = kind if kind == "int" else kind_of(self.source.schema[self.source.column].dataType.typeName())
        bucket = bucket_int(self.d.width, c) if kind == "int" else time_bucket(self.d.width, c, kind, timezone=self.d.timezone)
        df = df.withColumn("_bucket", bucket)
        for j in self.d.joins:
            df = df.join(j.table, j.on, j.how)
        if self.d.where is not None:
            df = df.where(self.d.where)
        out = df.groupBy("_bucket", *self.d.keys).agg(*[a.alias(n) for n, a in self.d.aggregates.items()])
        out = out.select(F.col("_bucket").alias(self.d.name), *self.d.keys, *self.d.aggregates)
        return out.where(self.d.having) if self.d.having is not None else out

    def add_column(self, name: str, aggregate: Column) -> None:
        """A further aggregate; buckets materialised before have null until they are refreshed."""
        self.d.aggregates[name] = aggregate
        self._validate()
        self.schema = self.aggregate(self.source.spark.createDataFrame([], self.source.schema)).schema

    def materialised(self) -> DataFrame:
        parts = [p for _, _, p in self.state["parts"]]
        spark = self.source.spark
        return spark.read.schema(self.schema).parquet(*parts) if parts else spark.createDataFrame([], self.schema)

    def view(self) -> DataFrame:
        """Materialised rows below the watermark, and fresh ones from it on unless materialized_only."""
        done = self.materialised()
        if self.d.materialized_only:
            return done
        w = self.state["watermark"]
        if w == LOWEST:
            return self.aggregate(self.source.rows())
        return done.unionByName(self.aggregate(self.source.rows(low=self._outer(w))))

    def invalid(self) -> list:
        """Ranges that a refresh would have to look at."""
        return merge_ranges(self.state["pending"] + self.source.changes[self.state["seen"] :])

    def refresh(self, start=None, end=None, force: bool = False, buckets_per_batch: int = 0, max_batches: int = 0, newest_first: bool = True) -> int:
        """Materialise changed buckets inside [start, end); returns how many ranges were written.

        buckets_per_batch cuts ranges; max_batches ends the call after so many, what is left stays pending.
        """
        extent = self.source.extent()
        last = self._next(self._floor(extent[1])) if extent else LOWEST
        if extent is None and not self.state["parts"]:
            return 0
        known = [a for a, _, _ in self.state["parts"]] + ([self._floor(extent[0])] if extent else [])
        last = max([last, *[b for _, b, _ in self.state["parts"]]])
        low = LOWEST if start is None else self._internal(start)
        if start is not None and self._floor(low) != low:
            low = self._next(self._floor(low))
        high = last if end is None else self._floor(self._internal(end))
        if end is not None and start is not None and high <= low:
            raise ValueError("refresh window too small: it must cover at least one bucket")
        high = min(high, last)
        if low >= high:
            return 0
        mark = self._register(low, high)
        try:
            return self._refresh(low, high, min(known), force, buckets_per_batch, max_batches, newest_first)
        finally:
            self.files.delete(mark)

    def _register(self, low: int, high: int) -> str:
        """Put the window up; windows that overlap one in work are refused."""
        folder, own = f"{self.root}/refreshing", f"{low}_{high}_{time.time():.0f}_{uuid.uuid4().hex}"
        self.files.create(f"{folder}/{own}", "")
        for f in self.files.fs.listStatus(self.files.path(folder)):
            name = f.getPath().getName()
            if name != own and name.count("_") == 3:
                a, b, since, _ = name.split("_")
                if int(a) < high and low < int(b) and time.time() - int(since) < STALE:
                    self.files.delete(f"{folder}/{own}")
                    raise ValueError("another refresh of an overlapping window is running")
        return f"{folder}/{own}"

    def _refresh(self, low: int, high: int, first: int, force: bool, buckets_per_batch: int, max_batches: int, newest_first: bool) -> int:
        self.source.raise_threshold(high)
        pending = self.invalid()
        self.state["seen"] = len(self.source.changes)
        inside, outside = cut_ranges(pending, low, high)
        if force:
            inside = [[max(low, first), high - 1]]
        inside = [[max(a, first), b] for a, b in inside if b >= first]
        whole = merge_ranges([[self._floor(a), self._next(self._floor(b)) - 1] for a, b in inside])
        if buckets_per_batch:
            cut = []
            for a, b in whole:
                while a <= b:
                    e = a
                    for _ in range(buckets_per_batch):
                        e = self._next(e)
                    cut.append([a, min(e - 1, b)])
                    a = e
            whole = cut[::-1] if newest_first else cut
        now = whole[:max_batches] if max_batches else whole
        self.state["pending"] = merge_ranges(outside + whole[len(now) :])
        old = []
        for a, b in now:
            old += self._replace(a, b + 1)
        self._save()
        for p in old:
            self.files.delete(p)
        return len(now)

    def _replace(self, low: int, high: int) -> list[str]:
        """Write the buckets of [low, high) as a new part; parts that overlap lose them. Returns folders no longer needed."""
        path, spark = f"{self.root}/mat/{uuid.uuid4().hex}", self.source.spark
        self.aggregate(self.source.settled(low=self._outer(low), high=self._outer(high))).write.parquet(path)
        parts, old, t = [], [], internal(F.col(self.d.name), self.source.kind)
        for a, e, p in self.state["parts"]:
            if e <= low or a >= high:
                parts.append([a, e, p])
                continue
            old.append(p)
            for x, y, mine in ((a, low, t < low), (high, e, t >= high)):
                if x < y:
                    rest = f"{self.root}/mat/{uuid.uuid4().hex}"
                    spark.read.schema(self.schema).parquet(p).where(mine).write.parquet(rest)
                    parts.append([x, y, rest])
        self.state["parts"] = [*parts, [low, high, path]]
        self.state["log"].append([low, high - 1])
        if (newest := spark.read.schema(self.schema).parquet(path).agg(F.max(t)).first()[0]) is not None:
            self.state["watermark"] = max(self.state["watermark"], self._next(newest))
        return old


def roll_up(cagg: ContinuousAggregate, width, aggregates: dict[str, Column], keys: list[str] | None = None, name: str = "bucket") -> DataFrame:
    """A wider aggregate over a continuous aggregate's view; widths must be multiples."""
    kind = cagg.source.kind
    nests(width, cagg.d.timezone, cagg.d.width, cagg.d.timezone)
    bucket = bucket_int(width, F.col(cagg.d.name)) if kind == "int" else time_bucket(width, F.col(cagg.d.name), kind, timezone=cagg.d.timezone)
    return cagg.view().groupBy(bucket.alias("_b"), *(keys or [])).agg(*[x.alias(n) for n, x in aggregates.items()]).withColumnRenamed("_b", name)


def usable(cagg: ContinuousAggregate, table: Hypertable, query: Definition) -> bool:
    """Whether the query may be answered by the aggregate: equal definition, real-time, nothing invalid below its watermark."""
    text = lambda c: None if c is None else str(c)
    d = cagg.d
    same = cagg.source.root == table.root and (d.width, d.timezone, d.keys, text(d.where), text(d.having), d.joins) == (query.width, query.timezone, query.keys, text(query.where), text(query.having), query.joins)
    fresh = not cut_ranges(cagg.invalid(), LOWEST, cagg.state["watermark"])[0]
    known = {str(a) for a in d.aggregates.values()}
    return same and fresh and not d.materialized_only and all(str(a) in known for a in query.aggregates.values())


def answer(caggs: list[ContinuousAggregate], table: Hypertable, query: Definition) -> DataFrame:
    """A bucket query, from a usable continuous aggregate, else from rows."""
    for c in caggs:
        if usable(c, table, query):
            known = {str(a): n for n, a in c.d.aggregates.items()}
            return c.view().select(F.col(c.d.name).alias(query.name), *query.keys, *[F.col(known[str(a)]).alias(n) for n, a in query.aggregates.items()])
    return ContinuousAggregate(table, f"{table.root}/_none", query).aggregate(table.read(table.chunks()))
