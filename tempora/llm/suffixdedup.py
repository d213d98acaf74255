"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

Distribution. Of the windows of `length` bytes, each is given to an anchor, the
position in it whose K-gram hash is smallest. Equal windows have their anchor at
the same place, so window starts fall into runs of equal anchor, cut into
blocks by distance to the anchor. All windows of a block share their middle;
its hash is the block's key, and equal windows always meet under equal keys.
A block's context is the text that its windows cover. Blocks are counted by
(key, context) before anything else moves: keys found once end there, contexts
found twice need no further look, and only keys with several contexts go on.

Within a bucket of such keys, contexts are joined into one string with a
Burrows-Wheeler transform. Starting from the empty string, intervals are
extended backward by one byte, breadth first: an interval reached at depth d
gives the common prefix d - 1 at its right border if that is not known yet,
so values come in increasing order and the search stops at `length`. Borders
never set then separate suffixes with at least `length` bytes in common.

Keys with more than HOT contexts (a passage at whose edge everything differs)
don't go to one task: their windows are hashed and counted one by one instead.

Texts move twice: documents with open contexts, and all for the removal.

Edge cases: null text is empty; texts shorter than `length` lose nothing;
repeated rows are different places, so all their windows repeat; null doc_id
stays null; removal is judged on the input; bytes left may not be valid UTF-8
and are returned as binary; a very long text is worked on whole, a task holding
one at a time; an empty table gives an empty one; further columns stay, but
those named as the operator's own are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, mix, powers, signed, skew_lookup, slices, staged, text_buffer

LENGTH = 400
K = 64
BLOCK = 128
HOT = 2000
#: Bytes of contexts in one Burrows-Wheeler transform.
BUCKET = 1 << 20
U64 = np.uint64
_TABLE = constants(211, 256)


def rolling(data: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of those byte ranges."""
    n = len(data)
    p, q = powers(n + 1, 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(_TABLE[data] * p[:n], out=total[1:])

    def of(start, end):
        with np.errstate(over="ignore"):
            return mix((total[end] - total[start]) * q[start] + (end - start).astype(U64))

    return of


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - w + 1
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def blocks(data: np.ndarray, offsets: np.ndarray, length: int):
    """Blocks of window starts of a run of texts: (text, first start, starts, key, context hash)."""
    n, width = len(data), length - K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, U64), np.zeros(0, U64)
    of = rolling(data)
    at = np.arange(n - K + 1)
    grams = of(at, at + K)
    low = sliding_min((grams >> U64(32) << U64(32)) | at.astype(U64), width)
    anchor = (low & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)[: len(start)]
    valid = start + length <= offsets[doc + 1]
    start, anchor, doc = start[valid], anchor[valid], doc[valid]
    if not len(start):
        return none, none, none, np.zeros(0, U64), np.zeros(0, U64)
    part = (anchor - start) // BLOCK
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(fresh)
    many = np.diff(np.append(begin, len(start)))
    s, a, b = start[begin], anchor[begin], part[begin]
    middle = of(a - b * BLOCK, a - (b + 1) * BLOCK + 1 + length)
    with np.errstate(over="ignore"):
        key = mix(middle + grams[a] * U64(3) + b.astype(U64))
    context = of(s, s + many - 1 + length)
    return doc[begin], s - offsets[doc[begin]], many, key, context


SCHEMA = "key long, context long, doc_id long, text_hash long, first int, starts int"


def places(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids, marks = batch.column(names.index("doc_id")), batch.column(names.index("text_hash"))
            for i, _, data, offsets in slices(*text_buffer(batch.column(names.index("text")))):
                doc, first, starts, key, context = blocks(data, offsets, length)
                if len(doc):
                    at = pa.array(i + doc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), pa.array(signed(context)), ids.take(at), marks.take(at), pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32))],
                        names=["key", "context", "doc_id", "text_hash", "first", "starts"],
                    )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- the transform


def suffix_array(text: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of contexts (symbols over 0, each context closed by a 0 at end[i]) in order of `length` symbols at least."""
    n = len(text)
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(7):  # seven symbols to begin with
        inside = at + j < end
        key = key * 257 + np.where(inside, text[np.minimum(at + j, n - 1)], 0)
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step + 1
        if depth >= length or step[-1] == n - 1:
            return order
        nxt = np.where(at + depth < end, rank[np.minimum(at + depth, n - 1)], 0)
        key = rank * (n + 2) + nxt
        depth *= 2


def long_prefixes(text: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, joined): joined[i] tells that suffixes i - 1 and i of the order share at least `length` symbols."""
    n = len(text)
    order = suffix_array(text, end, length)
    before = np.where(order > 0, text[order - 1], 0)  # the transform; 0 where a context begins
    rows = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where extending a row backward leads
    step[rows] = np.arange(n)
    prefix = np.full(n + 1, -1, np.int32)
    prefix[0] = prefix[n] = 0
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for depth in range(length):
        size = high - low
        row = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        symbol = before[row].astype(np.int64)
        group = np.repeat(np.arange(len(low)), size) * 257 + symbol
        if depth:  # nothing stands before a context's first symbol
            real = symbol > 0
            row, group = row[real], group[real]
        if not len(row):
            break
        by = np.argsort(group, kind="stable")
        group, target = group[by], step[row[by]]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        last = np.append(first[1:], len(group)) - 1
        low, high = target[first], target[last] + 1
        new = prefix[high] < 0
        border, once = np.unique(high[new], return_index=True)
        low, high = low[new][once], high[new][once]
        prefix[border] = depth
        if not len(low):
            break
    return order, prefix[:n] < 0


def repeated_starts(contexts: list[bytes], starts: list[int], counts: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its window starts repeat in another place of any context."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    raw = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    end = (begin + sizes)[owner]
    text[np.arange(len(text)) != end] = raw
    order, joined = long_prefixes(text, end, length)
    again = joined.copy()
    again[:-1] |= joined[1:]
    found = np.zeros(len(text), bool)
    found[order] = again
    found &= np.arange(len(text)) + length <= end
    return [found[b : b + s] | (c > 1) for b, s, c in zip(begin.tolist(), starts, counts, strict=True)]


def intervals(flags: np.ndarray) -> list[int]:
    """First and end of each run of set flags, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


# ---------------------------------------------------------------- the operator


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, context, n, starts, bytes: the text of each wanted context (rank, text_hash, first, starts, ...)."""
    lists = wanted.groupBy(F.col("rank").alias("_rank"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("key", "context", "n", "hot", "first", "starts")).alias("cuts"))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_rank"), F.xxhash64("text").alias("_hash"), "text").join(lists, ["_rank", "_hash"]).dropDuplicates(["_rank", "_hash"])

    def run(batches):
        fields = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("starts", pa.int32()), ("piece", pa.binary())])
        for batch in batches:
            names = batch.schema.names
            out = []
            for text, cuts in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("cuts")).to_pylist(), strict=True):
                raw = (text or "").encode()
                out += [{**{c: x[c] for c in ("key", "context", "n", "hot", "starts")}, "piece": raw[x["first"] : x["first"] + x["starts"] - 1 + LENGTH]} for x in cuts]
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.mapInArrow(run, "key long, context long, n long, hot boolean, starts int, piece binary")


def judge(pieces: DataFrame, length: int) -> DataFrame:
    """key, context, flat: intervals of repeated starts of contexts whose key has several."""
    total = pieces.where("NOT hot").agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))

    def transform(table: pa.Table) -> pa.Table:
        contexts, counts, starts = table.column("piece").to_pylist(), table.column("n").to_pylist(), table.column("starts").to_pylist()
        flags = repeated_starts(contexts, starts, counts, length)
        return pa.table({"key": table.column("key"), "context": table.column("context"), "flat": pa.array([intervals(f) for f in flags], pa.list_(pa.int32()))})

    schema = "key long, context long, flat array<int>"
    usual = pieces.where("NOT hot").groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(transform, schema)

    def explode(batches):
        for batch in batches:
            names = batch.schema.names
            out: list[list] = [[], [], [], [], []]
            for key, context, n, starts, piece in zip(*[batch.column(names.index(c)).to_pylist() for c in ("key", "context", "n", "starts", "piece")], strict=True):
                of, at = rolling(np.frombuffer(piece, np.uint8)), np.arange(starts)
                for column, x in zip(out, (np.full(starts, key), np.full(starts, context), np.full(starts, n), at, signed(of(at, at + length))), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "context", "n", "at", "window"])

    windows = staged(pieces.where("hot").mapInArrow(explode, "key long, context long, n long, at long, window long"), "windows")
    counted = windows.groupBy("key", "window").agg(F.sum("n").alias("places"), F.count("*").alias("rows")).where("places > 1")
    again = skew_lookup(windows, staged(counted, "counted"), ["key", "window"], "rows")
    flags = again.groupBy("key", "context").agg(F.array_sort(F.collect_list(F.col("at").cast("int"))).alias("ats"))
    hot = flags.select("key", "context", F.flatten(F.transform("ats", lambda a: F.array(a, a + 1))).alias("flat"))
    return usual.unionByName(hot)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with _n_bytes, _n_removed, _n_spans, _kept (binary) and _removed (flat byte intervals)."""
    docs = docs.drop("_n_bytes", "_n_removed", "_n_spans", "_kept", "_starts", "_rank", "_hash")
    rank = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    held = staged(places(docs, length), "places").withColumn("rank", rank).drop("doc_id")
    by_context = held.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("rank", "text_hash", "first", "starts")).alias("one"))
    by_context = staged(by_context, "contexts")
    by_key = by_context.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    by_key = staged(by_key.withColumn("hot", F.col("kinds") > HOT), "keys")
    repeated = staged(skew_lookup(by_context, by_key, ["key"], "kinds"), "repeated")
    wanted = repeated.where("kinds > 1").select("key", "context", "n", "hot", "one.*")
    pieces = staged(cut_out(docs, wanted), "pieces")
    judged = judge(pieces, length)
    single = repeated.where("kinds = 1").select("key", "context", F.array(F.lit(0), F.col("one.starts")).alias("flat"))
    verdict = judged.unionByName(single).where(F.size("flat") > 0).join(by_context.select("key", "context", "n"), ["key", "context"])
    found = skew_lookup(held, staged(verdict, "verdict"), ["key", "context"], "n")
    shifted = F.transform("flat", lambda x: x + F.col("first"))
    drops = found.groupBy(F.col("rank").alias("_rank"), F.col("text_hash").alias("_hash")).agg(F.flatten(F.collect_list(shifted)).alias("_starts"))
    rows = docs.withColumns({"_rank": rank, "_hash": F.xxhash64("text")}).join(drops, ["_rank", "_hash"], "left").drop("_rank", "_hash")
    schema = rows.drop("_starts").schema.add("_n_bytes", "long").add("_n_removed", "long").add("_n_spans", "long").add("_kept", "binary")

    def remove(batches):
        for batch in batches:
            names = batch.schema.names
            out: list[list] = [[], [], [], []]
            for text, flat in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("_starts")), strict=True):
                raw, at, parts, n, spans = (text or "").encode(), 0, [], 0, 0
                if flat.is_valid:
                    pairs = np.array(flat.as_py(), np.int64).reshape(-1, 2)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    s, e = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] - 1 + length)
                    cut = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    for x, y in zip(s[cut].tolist(), e[np.append(cut[1:], len(e)) - 1].tolist(), strict=True):
                        parts.append(raw[at:x])
                        at, n, spans = y, n + y - x, spans + 1
                for column, x in zip(out, (len(raw), n, spans, b"".join([*parts, raw[at:]])), strict=True):
                    column.append(x)
            same = [(c, batch.column(k)) for k, c in enumerate(names) if c != "_starts"]
            new = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([x for _, x in same] + new, names=[f.name for f in schema.fields])

    return rows.mapInArrow(remove, schema)


def op8(docs: DataFrame) -> DataFrame:
    out = suffix_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (bytes, removed, spans, digest) from a table of all windows. For tests."""
    seen: dict = {}
    raws = {d: (t or "").encode() for d, t in rows}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            h = hash(raw[i : i + length])
            seen[h] = seen.get(h, 0) + 1
    out = {}
    for d, raw in raws.items():
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            if seen[hash(raw[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), len(intervals(gone)) // 2, hashlib.sha256(kept).hexdigest())
    return out
