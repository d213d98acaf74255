"""Time-partitioned tables: Parquet chunks in versioned directories under numbered manifests.

A chunk is a range of the open dimension, [start, end) in internal time, floored
from zero, and a slot of an optional hash dimension. Every write makes new files
and one new manifest, which must not exist yet: readers see whole versions, and
of two writers that start from one version the second fails. A manifest row
holds a chunk's ranges, status, rows, minimum and maximum of tracked columns and
bytes. Queries pick chunks by manifest before Spark plans the read; exclusion.py
tells which chunks a predicate may need.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import bucket_range
from ..functions.timeutil import interval, internal, kind_of, micros_of
from . import exclusion

UNCOMPRESSED, COMPRESSED, UNORDERED, FROZEN, PARTIAL = 0, 1, 2, 4, 8
DEFAULT_INTERVAL = {"short": 10_000, "integer": 100_000, "long": 1_000_000}


@dataclass(frozen=True)
class Dimension:
    column: str
    interval: object = None  # of an open dimension
    partitions: int = 0  # of a hash dimension


def by_range(column: str, chunk_interval=None) -> Dimension:
    return Dimension(column, interval=chunk_interval)


def by_hash(column: str, partitions: int) -> Dimension:
    return Dimension(column, partitions=partitions)


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version that this one was about to write."""


class Files:
    """Small files and folders through Hadoop's file system, so that any store works."""

    KEEP = 10

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.read_bytes = lambda s: jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist; whether it was written."""
        try:
            out = self.fs.create(self.path(path), False)
        except Exception as e:  # the JVM's FileAlreadyExistsException
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path(path)):
            return None
        with_stream = self.fs.open(self.path(path))
        try:
            return self.read_bytes(with_stream)
        finally:
            with_stream.close()

    def versions(self, folder: str) -> list[int]:
        if not self.fs.exists(self.path(folder)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def newest(self, folder: str) -> tuple[int, dict | None]:
        """(version, state) of the newest file that is whole; one being written is not."""
        for v in reversed(self.versions(folder)):
            try:
                return v, json.loads(self.read(f"{folder}/{v:012d}.json") or "")
            except ValueError:
                continue
        return 0, None

    def commit(self, folder: str, version: int, state: dict) -> None:
        if not self.create(f"{folder}/{version:012d}.json", json.dumps(state)):
            raise ConcurrentWrite(f"version {version} of {folder} was written by another writer; open it again and repeat")
        for v in self.versions(folder)[: -self.KEEP]:
            self.delete(f"{folder}/{v:012d}.json")

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.path(path)).getLength()


NOT_NULL = "NULL value in the time column violates not-null constraint"


class Hypertable:
    """A table at `root`. Use create() once and open() after. optimize=False reads every chunk (for comparisons)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files, self.optimize = spark, root.rstrip("/"), Files(spark, root), True
        self.version, self.state = self.files.newest(f"{self.root}/manifest")

    @staticmethod
    def open(spark: SparkSession, root: str) -> Hypertable:
        table = Hypertable(spark, root)
        if table.state is None:
            raise ValueError(f"no table at {root}")
        return table

    @staticmethod
    def create(spark: SparkSession, root: str, schema: T.StructType, time: Dimension, space: Dimension | None = None, stats: tuple = (), segmentby: tuple = (), orderby: tuple = (), bloom: tuple = (), data: DataFrame | None = None) -> Hypertable:
        table = Hypertable(spark, root)
        if table.state is not None:
            raise ValueError(f"table {root} is there already")
        kind = kind_of(schema[time.column].dataType.typeName())
        for c in (*stats, *segmentby, *orderby, *bloom):
            if c not in schema.names:
                raise ValueError(f"column {c} does not exist")
        for c in stats:
            if not isinstance(schema[c].dataType, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType)):
                raise ValueError(f"chunk skipping needs an integer or time column, not {c}")
        width = time.interval
        if width is None:
            width = 7 * 86_400_000_000 if kind != "int" else DEFAULT_INTERVAL[schema[time.column].dataType.typeName()]
        table.state = {
            "schema": schema.jsonValue(), "time": time.column, "kind": kind, "interval": 0, "space": [space.column, space.partitions] if space else None,
            "stats": list(stats), "segmentby": list(segmentby), "orderby": list(orderby), "bloom": list(bloom), "chunks": [], "next": 1, "changes": [], "threshold": None,
        }
        table.state["interval"] = table._width(width)
        table._save()
        if data is not None:
            table.append(data)
        return table

    def _save(self) -> None:
        self.files.commit(f"{self.root}/manifest", self.version + 1, self.state)
        self.version += 1

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    def _width(self, width) -> int:
        width = width if isinstance(width, int) else interval(width).width()
        if width <= 0:
            raise ValueError("chunk interval must be positive")
        return width

    def set_chunk_interval(self, width) -> None:
        """For chunks made from now on; they end where older ones begin."""
        self.state["interval"] = self._width(width)
        self._save()

    def set_partitions(self, n: int) -> None:
        """For chunks made from now on; older ones keep their number of slots."""
        if not self.state["space"]:
            raise ValueError("the table has no hash dimension")
        self.state["space"][1] = n
        self._save()

    def add_dimension(self, space: Dimension) -> None:
        if self.state["space"] or self.state["chunks"]:
            raise ValueError("a hash dimension can be added once, to an empty table")
        self.state["space"] = [space.column, space.partitions]
        self._save()

    # ---- columns

    def _time(self) -> Column:
        return internal(F.col(self.state["time"]), self.state["kind"])

    def _odd(self) -> list[dict]:
        """Chunks that are no whole cells of the present interval (merged, split, or made under another one)."""
        w = self.state["interval"]
        return [c for c in self.state["chunks"] if c["start"] % w or c["end"] - c["start"] != w]

    def _placed(self, df: DataFrame) -> DataFrame:
        """df with _chunk_start and _space: the chunk that holds the time, else the cell of the interval cut by its neighbours."""
        width, t = F.lit(self.state["interval"]).cast("bigint"), self._time()
        if self.state["space"]:
            column, n = self.state["space"]
            df = df.withColumn("_space", F.least(F.floor(exclusion.slot_hash(F.col(column)) / F.lit((1 << 31) // n)).cast("int"), F.lit(n - 1)))
        else:
            df = df.withColumn("_space", F.lit(0))
        start = t - F.pmod(t, width)
        if odd := self._odd():
            edges = sorted({x for c in odd for x in (c["start"], c["end"])})
            cut = F.greatest(start, F.array_max(F.filter(F.array(*[F.lit(x).cast("bigint") for x in edges]), lambda e: e <= t)))
            held = F.array(*[F.struct(F.lit(c["start"]).cast("bigint").alias("a"), F.lit(c["end"]).cast("bigint").alias("b"), F.lit(c["space"]).alias("s")) for c in odd])
            start = F.coalesce(F.get(F.filter(held, lambda x: (x["a"] <= t) & (t < x["b"]) & (x["s"] == F.col("_space"))), F.lit(0))["a"], cut)
        return df.withColumn("_chunk_start", F.when(t.isNull(), F.raise_error(F.lit(NOT_NULL)).cast("bigint")).otherwise(start))

    def _end(self, start: int, space: int) -> int:
        w = self.state["interval"]
        known = [c["end"] for c in self.state["chunks"] if c["start"] == start and c["space"] == space]
        return known[0] if known else min([start - start % w + w, *[x for c in self._odd() for x in (c["start"], c["end"]) if x > start]])

    def to_internal(self, v):
        return v if isinstance(v, int) else micros_of(v)

    # ---- writing

    def append(self, df: DataFrame) -> None:
        """Route rows to chunks; null times are refused. Chunks that exist get a further directory."""
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        self._add(self._files(self._placed(df).hint("rebalance", "_chunk_start", "_space"), UNCOMPRESSED))
        self._save()

    def _files(self, placed: DataFrame, status: int) -> list[dict]:
        """Write rows that have _chunk_start and _space; a chunk entry for each chunk written, without id and end."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        if status & COMPRESSED:
            order = [F.col(c) for c in (*self.state["segmentby"], *self.state["orderby"])]
            placed = placed.sortWithinPartitions("_chunk_start", "_space", *order, F.col(self.state["time"]).desc_nulls_first())
        writer = placed.write.partitionBy("_chunk_start", "_space")
        for c in self.state["bloom"]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", "0.022")
        try:
            writer.parquet(path)
        except Exception as e:
            if NOT_NULL in str(e):
                raise ValueError(NOT_NULL) from e
            raise
        if not any("_chunk_start=" in f.getPath().getName() for f in self.files.fs.listStatus(self.files.path(path))):
            return []
        whole = T.StructType([*self.schema.fields, T.StructField("_chunk_start", T.LongType()), T.StructField("_space", T.IntegerType())])
        t, tracked = self._time(), []
        for c in self.state["stats"]:
            value = internal(F.col(c), kind_of(self.schema[c].dataType.typeName()))
            tracked += [F.min(value).alias(f"lo_{c}"), F.max(value).alias(f"hi_{c}")]
        out = []
        for r in self.spark.read.schema(whole).parquet(path).groupBy("_chunk_start", "_space").agg(F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), *tracked).collect():  # one row a chunk
            part = f"{path}/_chunk_start={r._chunk_start}/_space={r._space}"
            slots = self.state["space"][1] if self.state["space"] else 1
            out.append({"id": 0, "start": r._chunk_start, "space": r._space, "slots": slots, "paths": [part], "rows": r.n, "lo": r.lo, "hi": r.hi, "status": status, "stats": {c: [r[f"lo_{c}"], r[f"hi_{c}"]] for c in self.state["stats"]}, "created": time.time(), "bytes": self.files.size(part), "raw_bytes": None})
        return out

    def _add(self, new: list[dict], record: bool = True) -> None:
        """Put entries from _files into the state: as parts of chunks that are there, or as new ones."""
        for c in new:
            end = self._end(c["start"], c["space"])
            old = next((x for x in self.state["chunks"] if (x["start"], x["end"], x["space"], x["slots"]) == (c["start"], end, c["space"], c["slots"])), None)
            if old is None:
                self._new(c, end)
                continue
            self._unfrozen([old])
            if old["rows"] == 0:
                old["lo"], old["hi"], old["stats"] = c["lo"], c["hi"], c["stats"]
            old["stats"] = joined([old, c])
            old["paths"] += c["paths"]
            old["rows"], old["lo"], old["hi"], old["bytes"] = old["rows"] + c["rows"], min(old["lo"], c["lo"]), max(old["hi"], c["hi"]), old["bytes"] + c["bytes"]
            if old["status"] & COMPRESSED:
                old["status"] |= PARTIAL
        if record:
            self._changed(new)

    def _new(self, c: dict, end: int, **fields) -> dict:
        c.update({"end": end, **fields})
        c["id"], self.state["next"] = self.state["next"], self.state["next"] + 1
        self.state["chunks"].append(c)
        return c

    def _changed(self, chunks: list[dict]) -> None:
        """Log the range of changed times, below the threshold only: what is above was never materialised."""
        limit, spans = self.state["threshold"], [(c["lo"], c["hi"]) for c in chunks if c["rows"]]
        if spans and limit is not None and min(a for a, _ in spans) < limit:
            self.state["changes"].append([min(a for a, _ in spans), max(b for _, b in spans)])

    def raise_threshold(self, to: int) -> None:
        """The end of what any aggregate has materialised; it never moves back."""
        if self.state["threshold"] is None or to > self.state["threshold"]:
            self.state["threshold"] = to
            self._save()

    def _unfrozen(self, chunks: list[dict]) -> None:
        if any(c["status"] & FROZEN for c in chunks):
            raise ValueError("chunk is frozen")

    def _swap(self, old: list[dict], rows: DataFrame | None) -> None:
        """Replace chunks by rows, which keep their chunks' ranges and order or move where they belong; then the old files go."""
        self._unfrozen(old)
        status = COMPRESSED if any(c["status"] & COMPRESSED for c in old) else UNCOMPRESSED
        ids = {c["id"] for c in old}
        new = self._files(self._placed(rows).hint("rebalance", "_chunk_start", "_space"), status) if rows is not None else []
        by = {(c["start"], c["space"]): c for c in old}
        stay = [c for c in new if (c["start"], c["space"]) in by]
        gone = [p for c in old for p in c["paths"]]
        self.state["chunks"] = [c for c in self.state["chunks"] if c["id"] not in ids]
        for c in stay:
            was = by[c["start"], c["space"]]
            self.state["chunks"].append({**c, "id": was["id"], "end": was["end"], "slots": was["slots"], "status": was["status"] & ~PARTIAL, "created": was["created"], "raw_bytes": was["raw_bytes"]})
        self._add([c for c in new if c not in stay], record=False)
        self._changed([*old, *new])
        self._save()
        for p in gone:
            self.files.delete(p)

    # ---- reading

    def chunks(self, low=None, high=None, space_value=None, ranges: dict | None = None) -> list[dict]:
        """Manifest rows that may hold times in [low, high), the hashed value, and values in ranges (column: (low, high))."""
        out = self.state["chunks"]
        if not self.optimize:
            return sorted(out, key=lambda c: (c["start"], c["space"]))
        if low is not None:
            out = [c for c in out if c["rows"] and c["hi"] >= self.to_internal(low)]
        if high is not None:
            out = [c for c in out if c["rows"] and c["lo"] < self.to_internal(high)]
        if space_value is not None and self.state["space"]:
            h = exclusion.hashes(self.spark, [space_value], self.schema[self.state["space"][0]].dataType)[space_value]
            out = [c for c in out if exclusion.slot(h, c["slots"]) == c["space"]]
        for column, (a, b) in (ranges or {}).items():
            out = [c for c in out if exclusion.overlaps(c["stats"].get(column), None if a is None else self.to_internal(a), None if b is None else self.to_internal(b))]
        return sorted(out, key=lambda c: (c["start"], c["space"]))

    def read(self, chunks: list[dict]) -> DataFrame:
        paths = [p for c in chunks for p in c["paths"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def scan(self, low=None, high=None, space_value=None, ranges: dict | None = None) -> DataFrame:
        """Rows with low <= time < high, the hash column's value, and values in ranges; chunks are excluded first."""
        df, t = self.read(self.chunks(low, high, space_value, ranges)), F.col(self.state["time"])
        if low is not None:
            df = df.where(t >= F.lit(low))
        if high is not None:
            df = df.where(t < F.lit(high))
        if space_value is not None:
            df = df.where(F.col(self.state["space"][0]) == F.lit(space_value))
        for column, (a, b) in (ranges or {}).items():
            if a is not None:
                df = df.where(F.col(column) >= F.lit(a))
            if b is not None:
                df = df.where(F.col(column) <= F.lit(b))
        return df

    def needed(self, where: Column | str) -> list[dict]:
        """Chunks that may hold rows for which the predicate is true."""
        every = self.chunks()
        if not self.optimize or not every:
            return every
        condition = exclusion.optimised(self.read(every[:1]).where(where))
        if condition is None:
            return every
        return exclusion.Test(self).chunks(condition, every)

    def query(self, where: Column | str | None = None, buckets: tuple = ()) -> DataFrame:
        """Rows for which `where` is true and, for (op, width, value) in buckets, the time's bucket compares so to value.

        Chunks are excluded by comparisons, IN, BETWEEN, AND and OR over the
        time column, the hash column and columns with statistics, now() included.
        """
        bounds = [bucket_range(op, width, value) for op, width, value in buckets]
        low = max([a for a, _ in bounds if a is not None], default=None)
        high = min([b for _, b in bounds if b is not None], default=None)
        chosen = self.needed(where) if where is not None else self.chunks()
        inside = {c["id"] for c in self.chunks(low, high)}
        df, t = self.read([c for c in chosen if c["id"] in inside]), F.col(self.state["time"])
        for bound, test in ((low, lambda b: t >= F.lit(b)), (high, lambda b: t < F.lit(b))):
            if bound is not None:
                df = df.where(test(bound))
        return df if where is None else df.where(where)

    def joined_scan(self, other: DataFrame, column: str | None = None) -> DataFrame:
        """Rows that may join with other on a time column of its name: chunks outside other's range are left out at run time."""
        column = column or self.state["time"]
        r = other.agg(F.min(self._time()).alias("a"), F.max(self._time()).alias("b")).first()
        if r.a is None:
            return self.read([])
        return self.read([c for c in self.chunks() if c["rows"] and c["hi"] >= r.a and c["lo"] <= r.b])

    def only(self) -> DataFrame:
        """The parent without its chunks: no rows."""
        return self.read([])

    def chunk(self, chunk: int) -> DataFrame:
        return self.read([self._chunk(chunk)])

    def _chunk(self, chunk: int) -> dict:
        found = next((c for c in self.state["chunks"] if c["id"] == chunk), None)
        if found is None:
            raise ValueError(f"chunk {chunk} not found")
        return found

    def extremes(self, column: str) -> tuple | None:
        """(min, max) of the time column or a column with statistics, in internal form, from the manifest alone."""
        held = [c for c in self.state["chunks"] if c["rows"]]
        if column == self.state["time"]:
            return (min(c["lo"] for c in held), max(c["hi"] for c in held)) if held else None
        if column not in self.state["stats"]:
            raise ValueError(f"{column} has no statistics")
        pairs = [c["stats"][column] for c in held if c["stats"][column][0] is not None]
        return (min(a for a, _ in pairs), max(b for _, b in pairs)) if pairs else None

    def latest(self, n: int, where: Column | str | None = None) -> DataFrame:
        """The n newest rows: chunks are opened from the newest until they hold n rows."""
        candidates = self.needed(where) if where is not None else self.chunks()
        chosen, held, lowest = [], 0, None
        for c in sorted(candidates, key=lambda c: -c["hi"] if c["rows"] else 1 << 62):
            if held >= n and c["hi"] < lowest:  # what is left is older than n rows found
                break
            chosen.append(c)
            held += self.read([c]).where(where).count() if where is not None else c["rows"]
            lowest = min(x["lo"] for x in chosen)
        out = self.read(chosen)
        return (out if where is None else out.where(where)).orderBy(F.col(self.state["time"]).desc()).limit(n)

    def ordered(self, descending: bool = False) -> DataFrame:
        """All rows in time order. Chunks are ordered already, so each is sorted alone and none is sampled or merged."""
        if self.state["space"]:
            return self.read(self.chunks()).orderBy(F.col(self.state["time"]).desc() if descending else F.col(self.state["time"]))
        key = F.col(self.state["time"]).desc() if descending else F.col(self.state["time"])
        parts = [self.read([c]).coalesce(1).sortWithinPartitions(key) for c in sorted(self.chunks(), key=lambda c: c["start"], reverse=descending)]
        out = parts[0] if parts else self.read([])
        for x in parts[1:]:
            out = out.union(x)
        return out

    def approximate_row_count(self) -> int:
        return sum(c["rows"] for c in self.state["chunks"])

    def show_chunks(self, older_than=None, newer_than=None, created_before=None, created_after=None) -> list[dict]:
        out = self.state["chunks"]
        if older_than is not None:
            out = [c for c in out if c["end"] <= self.to_internal(older_than)]
        if newer_than is not None:
            out = [c for c in out if c["start"] >= self.to_internal(newer_than)]
        if created_before is not None:
            out = [c for c in out if c["created"] < created_before]
        if created_after is not None:
            out = [c for c in out if c["created"] > created_after]
        return sorted(out, key=lambda c: c["id"])

    def drop_chunks(self, **which) -> list[int]:
        if not which:
            raise ValueError("drop_chunks needs a bound")
        gone = self.show_chunks(**which)
        self._unfrozen(gone)
        ids = {c["id"] for c in gone}
        self.state["chunks"] = [c for c in self.state["chunks"] if c["id"] not in ids]
        self._save()
        for c in gone:
            for p in c["paths"]:
                self.files.delete(p)
        return sorted(ids)

    def truncate(self) -> None:
        if old := list(self.state["chunks"]):
            self._swap(old, None)

    # ---- layout

    def rewrite(self, ids: list[int], status: int = COMPRESSED) -> None:
        """Rewrite chunks sorted by segmentby and orderby, small files merged; each keeps its range. Earlier files go after the commit."""
        old = [self._chunk(i) for i in ids]
        self._unfrozen(old)
        slots = self.state["space"][1] if self.state["space"] else 1
        present, gone = [c for c in old if c["slots"] == slots], []
        for group in [present, *[[c] for c in old if c["slots"] != slots]]:  # one job for all but chunks of an earlier number of slots
            if not group:
                continue
            if group is present:
                placed = self._placed(self.read(group)).hint("rebalance", "_chunk_start", "_space")
            else:
                placed = self.read(group).withColumns({"_chunk_start": F.lit(group[0]["start"]).cast("bigint"), "_space": F.lit(group[0]["space"])}).hint("rebalance")
            new = {(x["start"], x["space"]): x for x in self._files(placed, status)}
            for c in group:
                if not c["rows"]:
                    continue
                x = new.pop((c["start"], c["space"]))
                gone += c["paths"]
                c.update({"paths": x["paths"], "raw_bytes": c["raw_bytes"] if c["status"] & COMPRESSED else c["bytes"], "bytes": x["bytes"], "status": status})
            assert not new, "rows outside their chunk"
        self._save()
        for p in gone:
            self.files.delete(p)

    def compress(self, **which) -> None:
        """Chunks not yet compressed, and those with parts added since."""
        self.rewrite([c["id"] for c in self.show_chunks(**which) if not c["status"] & COMPRESSED or c["status"] & PARTIAL])

    def decompress(self, **which) -> None:
        self.rewrite([c["id"] for c in self.show_chunks(**which) if c["status"] & COMPRESSED], UNCOMPRESSED)

    def freeze(self, chunk: int, on: bool = True) -> None:
        c = self._chunk(chunk)
        c["status"] = c["status"] | FROZEN if on else c["status"] & ~FROZEN
        self._save()

    def merge_chunks(self, ids: list[int]) -> None:
        """Adjacent chunks of one hash slot become one."""
        old = sorted((self._chunk(i) for i in set(ids)), key=lambda c: c["start"])
        if len(old) < 2:
            raise ValueError("merging needs two chunks at least")
        self._unfrozen(old)
        if len({(c["space"], c["slots"]) for c in old}) != 1 or any(a["end"] != b["start"] for a, b in zip(old, old[1:], strict=False)):
            raise ValueError("only adjacent chunks can be merged")
        held = [c for c in old if c["rows"]] or old
        status = old[0]["status"] if len({c["status"] for c in old}) == 1 else max(c["status"] & COMPRESSED for c in old) | PARTIAL
        one = {**old[0], "paths": [p for c in old for p in c["paths"]], "rows": sum(c["rows"] for c in old), "lo": min(c["lo"] for c in held), "hi": max(c["hi"] for c in held), "bytes": sum(c["bytes"] for c in old), "stats": joined(held), "status": status}
        self.state["chunks"] = [c for c in self.state["chunks"] if c["id"] not in set(ids)]
        self._new(one, old[-1]["end"])
        self._save()

    def split_chunk(self, chunk: int, at=None) -> None:
        """At a time, or in the middle of its range."""
        c = self._chunk(chunk)
        cut = (c["start"] + c["end"]) // 2 if at is None else self.to_internal(at)
        self._unfrozen([c])
        if not c["start"] < cut < c["end"]:
            raise ValueError("split point must be inside the chunk")
        placed = self.read([c]).withColumns({"_chunk_start": F.when(self._time() < cut, F.lit(c["start"]).cast("bigint")).otherwise(F.lit(cut).cast("bigint")), "_space": F.lit(c["space"])})
        new = self._files(placed.hint("rebalance", "_chunk_start"), c["status"])
        self.state["chunks"] = [x for x in self.state["chunks"] if x["id"] != chunk]
        for x in new:
            self._new(x, cut if x["start"] < cut else c["end"], slots=c["slots"])
        self._save()
        for p in c["paths"]:
            self.files.delete(p)

    def attach(self, path: str) -> None:
        """Rows of a Parquet folder outside the table, as chunks."""
        self.append(self.spark.read.schema(self.schema).parquet(path))

    def attach_chunk(self, path: str, start, end, space: int = 0) -> int:
        """A Parquet folder becomes the chunk [start, end) where it is; its rows must belong there."""
        a, b = self.to_internal(start), self.to_internal(end)
        slots = self.state["space"][1] if self.state["space"] else 1
        if any(c["space"] == space and c["start"] < b and a < c["end"] for c in self.state["chunks"]):
            raise ValueError("the range overlaps a chunk")
        df, t = self.spark.read.schema(self.schema).parquet(path), self._time()
        tracked = [f(internal(F.col(c), kind_of(self.schema[c].dataType.typeName()))).alias(f"{n}_{c}") for c in self.state["stats"] for n, f in (("lo", F.min), ("hi", F.max))]
        own = F.col("_space") == space
        r = self._placed(df).agg(F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.coalesce(F.bool_and((t >= a) & (t < b) & own), F.lit(True)).alias("fits"), *tracked).first()
        if not r.fits:
            raise ValueError("rows outside the chunk's range or slot")
        stats = {c: [r[f"lo_{c}"], r[f"hi_{c}"]] for c in self.state["stats"]}
        c = self._new({"id": 0, "start": a, "space": space, "slots": slots, "paths": [path], "rows": r.n, "lo": a if r.lo is None else r.lo, "hi": a if r.hi is None else r.hi, "status": UNCOMPRESSED, "stats": stats, "created": time.time(), "bytes": self.files.size(path), "raw_bytes": None}, b)
        self._changed([c])
        self._save()
        return c["id"]

    def detach_chunk(self, chunk: int) -> list[str]:
        """Take a chunk out of the table; its files stay and are returned."""
        c = self._chunk(chunk)
        self._unfrozen([c])
        self.state["chunks"] = [x for x in self.state["chunks"] if x["id"] != chunk]
        self._changed([c])
        self._save()
        return c["paths"]

    # ---- information

    def chunk_table(self) -> DataFrame:
        rows = [(c["id"], c["start"], c["end"], c["space"], c["rows"], c["status"], c["bytes"]) for c in self.state["chunks"]]
        return self.spark.createDataFrame(rows, "chunk_id long, range_start long, range_end long, space int, rows long, status int, bytes long")

    def size(self) -> int:
        return sum(c["bytes"] for c in self.state["chunks"])

    def compression_stats(self) -> DataFrame:
        rows = [(c["id"], bool(c["status"] & COMPRESSED), c["raw_bytes"], c["bytes"]) for c in self.state["chunks"]]
        return self.spark.createDataFrame(rows, "chunk_id long, compressed boolean, before_bytes long, after_bytes long")


def joined(chunks: list[dict]) -> dict:
    """Statistics over several chunks; a column that is null all over has none."""
    out = {}
    for k in chunks[0]["stats"]:
        pairs = [c["stats"][k] for c in chunks if c["stats"][k][0] is not None]
        out[k] = [min(a for a, _ in pairs), max(b for _, b in pairs)] if pairs else [None, None]
    return out


# ---------------------------------------------------------------- changes


def _hits(table: Hypertable, where: Column | str, low, high) -> tuple[list[dict], dict[int, int]]:
    """Chunks that hold rows for which where is true, and how many; a row a chunk's folder is collected."""
    inside = {c["id"] for c in table.chunks(low, high)}
    candidates = [c for c in table.needed(where) if c["id"] in inside]
    if not candidates:
        return [], {}
    files = table.read(candidates).where(where).groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+/_chunk_start=[^/]+/_space=[^/]+|[^/]+)/[^/]+$", 1).alias("at")).count().collect()
    found = {r.at: r["count"] for r in files}
    count = {c["id"]: sum(n for at, n in found.items() if any(p.endswith(at) for p in c["paths"])) for c in candidates}
    return [c for c in candidates if count[c["id"]]], count


def _kept(table: Hypertable, rows: DataFrame) -> DataFrame:
    """Rows written aside, so that a result outlives the files it was read from."""
    path = f"{table.root}/returning/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return table.spark.read.schema(rows.schema).parquet(path)


def delete(table: Hypertable, where: Column | str, low=None, high=None, returning: bool = False):
    """Delete matching rows: their number, or the rows if returning. Chunks without matches stay; chunks that match whole go unread."""
    where_ = F.expr(where) if isinstance(where, str) else where
    old, count = _hits(table, where, low, high)
    table._unfrozen(old)
    gone = _kept(table, table.read(old).where(where)) if returning else sum(count.values())
    rest = [c for c in old if count[c["id"]] < c["rows"]]
    if old:
        table._swap(old, table.read(rest).where(~F.coalesce(where_, F.lit(False))) if rest else None)
    return gone


def update(table: Hypertable, values: dict[str, Column], where: Column | str, low=None, high=None, returning: bool = False):
    """Update matching rows: their number, or structs old and new if returning. Only chunks with matches are rewritten; rows may move."""
    where_ = F.expr(where) if isinstance(where, str) else where
    old, count = _hits(table, where, low, high)
    rows, hit, names = table.read(old), F.coalesce(where_, F.lit(False)), table.schema.names
    value = lambda c: values[c].cast(table.schema[c].dataType) if c in values else F.col(c)
    out = sum(count.values())
    if returning:
        out = _kept(table, rows.where(hit).select(F.struct(*names).alias("old"), F.struct(*[value(c).alias(c) for c in names]).alias("new")))
    if old:
        table._swap(old, rows.select(*[F.when(hit, value(c)).otherwise(F.col(c)).alias(c) for c in names]))
    return out


def _unique(table: Hypertable, keys: list[str]) -> None:
    need = [table.state["time"], *([table.state["space"][0]] if table.state["space"] else [])]
    if missing := [c for c in need if c not in keys]:
        raise ValueError(f"a unique key must hold the partitioning columns; it lacks {', '.join(missing)}")


def _touched(table: Hypertable, rows: DataFrame) -> list[dict]:
    """Chunks that rows would be routed to."""
    places = {(r._chunk_start, r._space) for r in table._placed(rows).select("_chunk_start", "_space").distinct().collect()}  # one row a chunk
    return [c for c in table.state["chunks"] if (c["start"], c["space"]) in places]


def upsert(table: Hypertable, df: DataFrame, keys: list[str], do: str = "update", where: Column | None = None, returning: bool = False) -> DataFrame | None:
    """INSERT ... ON CONFLICT (keys) DO nothing or update; rows inserted or updated (action) if returning.

    keys must hold the partitioning columns. Null keys never conflict. Under
    "update" a batch with two rows of one key is an error; under "nothing" the
    smallest of them goes in. where, over old_... and new columns, limits updates.
    """
    _unique(table, keys)
    names = table.schema.names
    new = df.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
    whole = [F.col(k).isNotNull() for k in keys]
    keyed = whole[0]
    for w in whole[1:]:
        keyed = keyed & w
    if do == "update" and new.where(keyed).groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError("ON CONFLICT DO UPDATE command cannot affect row a second time")
    if do == "nothing":
        one = new.where(keyed).groupBy(*keys).agg(F.min(F.struct(*[c for c in names if c not in keys])).alias("_v"))
        new = one.select(*[F.col(c) if c in keys else F.col(f"_v.{c}") for c in names]).unionByName(new.where(~keyed))
    old = _touched(table, new)
    held = table.read(old)
    fresh = new.join(held.select(*keys), keys, "left_anti").select(*names)
    if do == "nothing":
        fresh = _kept(table, fresh)
        table.append(fresh)
        return fresh.withColumn("action", F.lit("insert")) if returning else None
    pairs = new.join(held.select(*keys, *[F.col(c).alias(f"old_{c}") for c in names if c not in keys]), keys)
    updated = _kept(table, (pairs if where is None else pairs.where(where)).select(*names))
    inserted = _kept(table, fresh)
    hit = {c["id"] for c in _touched(table, updated)}
    chosen = [c for c in old if c["id"] in hit]
    if chosen:
        table._swap(chosen, table.read(chosen).join(updated.select(*keys), keys, "left_anti").select(*names).unionByName(updated))
    table.append(inserted)
    return updated.withColumn("action", F.lit("update")).unionByName(inserted.withColumn("action", F.lit("insert"))) if returning else None


def merge(table: Hypertable, source: DataFrame, keys: list[str], matched: str | dict = "update", not_matched: bool = True, not_matched_by_source: str = "keep") -> None:
    """MERGE: matched 'update', 'delete', 'keep' or {column: expression over s_... and t_...}; insert; 'delete' or 'keep' the rest.

    Only chunks with matches are rewritten, all of them if the rest is deleted.
    A target row with two source rows is an error unless matched is 'keep'.
    """
    names, s_names = table.schema.names, source.columns
    if matched != "keep" and source.groupBy(*keys).count().where("count > 1").join(table.read(table.chunks()).select(*keys), keys, "left_semi").take(1):
        raise ValueError("MERGE command cannot affect row a second time")
    every = table.chunks()
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in s_names]).withColumn("_s", F.lit(True))
    target = lambda df: df.select(*[F.col(c).alias(f"t_{c}") for c in names])
    fresh = s.join(target(table.read(every)), [F.col(f"s_{k}") == F.col(f"t_{k}") for k in keys], "left_anti")
    inserted = _kept(table, fresh.select(*[(F.col(f"s_{c}") if c in s_names else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in names])) if not_matched else None
    if matched != "keep" or not_matched_by_source == "delete":
        if not_matched_by_source == "delete":
            chosen = every
        else:
            hit = table.read(every).withColumn("_at", F.col("_metadata.file_path")).join(source.select(*keys).distinct(), keys, "left_semi").select("_at").distinct().collect()  # a row a file
            paths = [r._at.rpartition("/")[0] for r in hit]
            chosen = [c for c in every if any(x.endswith(p.rpartition("/data/")[2]) for x in paths for p in c["paths"])]
        if chosen:
            both = target(table.read(chosen)).join(s, [F.col(f"s_{k}") == F.col(f"t_{k}") for k in keys], "left")
            met = F.col("_s").isNotNull()
            keep = F.when(met, F.lit(matched != "delete")).otherwise(F.lit(not_matched_by_source == "keep"))

            def value(c):
                if isinstance(matched, dict):
                    new = matched.get(c, F.col(f"t_{c}"))
                else:
                    new = F.col(f"s_{c}") if matched == "update" and c in s_names else F.col(f"t_{c}")
                return F.when(met, new.cast(table.schema[c].dataType)).otherwise(F.col(f"t_{c}")).alias(c)

            table._swap(chosen, both.where(keep).select(*[value(c) for c in names]))
    if inserted is not None:
        table.append(inserted)
