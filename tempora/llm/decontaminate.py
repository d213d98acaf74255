"""Benchmark decontamination: prefix-filtered set join with exact window verification.

A window is 13 consecutive words of an item (or the whole of a shorter item).
Containment of a whole window needs each of its tokens, so one prefix token is
enough: the rarest by corpus counts over all documents. Documents' words are
matched against prefix tokens only; a match fixes the window's place by the
token's position in it, places that would start before or end after the text
are dropped, and the rest are compared word by word.

The benchmark is cut into blocks of at most BLOCK bytes (or of one item, if that
is longer); a block's index, some eight times its bytes, is sent to the
executors, one to count its words in all documents and one to match them. A
benchmark of one block needs no shuffle. Of a larger one, each further block's
matches are written before the next block is sent, so that two indexes at most
are held at a time, and joined to the documents by id and text at the end.

Edge cases: null or empty text has no words and no hits; items without words
match nothing; items with null id hit words but are not listed; equal items
are each listed; an empty benchmark hits nothing; every input row gives one row,
repeated rows too; very long texts are matched whole, a task holding one at a
time; further columns stay, but those named as the operator's own are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, slices, staged, text_buffer

WINDOW = 13
#: Bytes of item text in one block.
BLOCK = 4 << 20


def blocks(benchmark: DataFrame, limit: int):
    """Lists of (item_id, text), each of at most limit bytes unless one item is longer."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL").toLocalIterator():
        n = len(r.text.encode())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def same_runs(x: np.ndarray, n: int) -> np.ndarray:
    """A number for each n consecutive entries, the same for equal ones only: runs are doubled until they have n."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    rank, size = np.unique(x, return_inverse=True)[1], 1
    while size < n:
        step = min(size, n - size)
        rank = np.unique(rank[:-step] * len(x) + rank[step:], return_inverse=True)[1]
        size += step
    return rank


def item_windows(items: list, window: int):
    """(words of all items, first words of windows, their lengths, item numbers, numbers of different windows)."""
    data, offsets = text_buffer(pa.array([t for _, t in items], pa.large_string()))
    words = Words(data, offsets, ALNUM)
    h, counts = words.hashes(), words.counts
    owner = words.doc()
    at = np.flatnonzero(np.arange(len(h)) + window <= words.first[owner + 1])
    short = np.flatnonzero((counts > 0) & (counts < window))
    which = same_runs(h, window)[at]
    named: dict[bytes, int] = {}
    alone = [named.setdefault(h[words.first[d] : words.first[d + 1]].tobytes(), len(named)) for d in short]
    begin = np.concatenate([at, words.first[short]]).astype(np.int32)
    length = np.concatenate([np.full(len(at), window), counts[short]]).astype(np.int32)
    return h, begin, length, np.concatenate([owner[at], short]).astype(np.int32), np.concatenate([which, np.array(alone, np.int64) + len(h)])


def token_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each token of the vocabulary stands in all documents; the vocabulary bounds what is collected."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocab = shared.value
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(*text_buffer(batch.column("text"))):
                h = Words(data, offsets, ALNUM).hashes()
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                total += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in counted.toLocalIterator()}


class Index:
    """Windows of one block by their rarest token."""

    def __init__(self, items, docs: DataFrame, window: int):
        self.words, begin, length, owners, which = item_windows(items, window)
        self.names = [i for i, _ in items]
        _, one, which = np.unique(which, return_index=True, return_inverse=True)
        self.begin, self.lengths = begin[one], length[one]
        order = np.argsort(which, kind="stable")
        self.owners, self.owner_first = owners[order], np.searchsorted(which[order], np.arange(len(one) + 1))
        vocabulary, place = np.unique(self.words, return_inverse=True)
        counts = np.zeros(len(vocabulary), np.int64)
        if len(vocabulary):
            for k, n in token_counts(docs, vocabulary).items():
                counts[k] = n
        counts = counts[place]
        offset = np.zeros(len(one), np.int32)
        for j in range(1, window):
            some = np.flatnonzero(self.lengths > j)
            first = self.begin[some]
            offset[some[counts[first + j] < counts[first + offset[some]]]] = j
        rarest = self.words[self.begin + offset]
        order = np.argsort(rarest, kind="stable").astype(np.int32)
        self.window, self.offset = order, offset[order]
        self.prefix, first = np.unique(rarest[order], return_index=True)
        self.first = np.append(first, len(order))

    def match(self, words: Words):
        """(window, first word) of every occurrence in a run of texts."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(words.start):
            return none, none
        h, counts = words.hashes(), words.counts
        low, high = np.repeat(words.first[:-1], counts), np.repeat(words.first[1:], counts)
        at = np.minimum(np.searchsorted(self.prefix, h), len(self.prefix) - 1)
        hit = np.flatnonzero(self.prefix[at] == h)
        some, begun = at[hit], []
        found = []
        for i in range(0, len(hit), 1 << 16):  # a common prefix token may stand before many windows
            k, p = some[i : i + (1 << 16)], hit[i : i + (1 << 16)]
            n = self.first[k + 1] - self.first[k]
            entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            p = np.repeat(p, n)
            window, start = self.window[entry], p - self.offset[entry]
            fits = (start >= low[p]) & (start + self.lengths[window] <= high[p])
            window, start = window[fits], start[fits]
            for j in range(int(self.lengths.max())):
                if not len(window):
                    break
                inside = np.minimum(j, self.lengths[window] - 1)
                same = h[start + inside] == self.words[self.begin[window] + inside]
                window, start = window[same], start[same]
            found.append(window)
            begun.append(start)
        return (np.concatenate(found), np.concatenate(begun)) if found else (none, none)


def pass_block(docs: DataFrame, shared) -> DataFrame:
    """docs with _n_words, and with _hits (first and end word of merged runs) and _items grown by one block's matches."""

    def run(batches):
        own = shared.value
        for batch in batches:
            names = batch.schema.names
            hits = batch.column(names.index("_hits")).to_pylist()
            items = batch.column(names.index("_items")).to_pylist()
            total = np.zeros(batch.num_rows, np.int64)
            for i, j, data, offsets in slices(*text_buffer(batch.column(names.index("_whole")))):
                words = Words(data, offsets, ALNUM)
                total[i:j] = words.counts
                window, start = own.match(words)
                if not len(window):
                    continue
                order = np.argsort(start, kind="stable")
                window, start = window[order], start[order]
                doc = np.searchsorted(words.first, start, side="right") - 1
                for d in np.unique(doc):
                    mine = doc == d
                    s, e = start[mine] - words.first[d], start[mine] - words.first[d] + own.lengths[window[mine]]
                    old = hits[i + d]
                    hits[i + d] = merge([*zip(old[::2], old[1::2], strict=True), *zip(s.tolist(), e.tolist(), strict=True)])
                    seen = {own.names[o] for w in np.unique(window[mine]) for o in own.owners[own.owner_first[w] : own.owner_first[w + 1]]}
                    items[i + d] = sorted(seen.union(items[i + d]) - {None})
            new = {"_hits": pa.array(hits, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string())), "_n_words": pa.array(total)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

    return docs.mapInArrow(run, docs.schema)


def merge(spans: list) -> list[int]:
    """Union of spans as a flat list first, end, first, end, ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def further(docs: DataFrame, index: Index) -> DataFrame:
    """_rank, _hash, _hits and _items of the documents that one block hits, written."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    found = pass_block(docs.select("_rank", "_hash", "_whole", "_hits", "_items", "_n_words"), shared).where(F.size("_hits") > 0)
    out = staged(found.select("_rank", "_hash", "_hits", "_items").dropDuplicates(["_rank", "_hash"]), "hits")
    shared.unpersist()
    return out


def united(rows: DataFrame, more: list[DataFrame]) -> DataFrame:
    """rows with the matches of further blocks; a document has one row a block at most in them."""
    every = functools.reduce(DataFrame.unionByName, more)
    lists = every.groupBy("_rank", "_hash").agg(F.collect_list("_hits").alias("_more_hits"), F.collect_list("_items").alias("_more_items"))
    rows = rows.join(lists, ["_rank", "_hash"], "left")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            hits, items, more_hits, more_items = (batch.column(names.index(c)).to_pylist() for c in ("_hits", "_items", "_more_hits", "_more_items"))
            for i, lists in enumerate(more_hits):
                if lists:
                    hits[i] = merge([x for flat in (hits[i], *lists) for x in zip(flat[::2], flat[1::2], strict=True)])
                    items[i] = sorted({x for own in (items[i], *more_items[i]) for x in own})
            new = {"_hits": pa.array(hits, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

    return rows.mapInArrow(run, rows.schema).drop("_more_hits", "_more_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with _n_words, _hits, _items, _n_hit and _contaminated."""
    start = {"_whole": F.coalesce("text", F.lit("")), "_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<string>"), "_n_words": F.lit(0).cast("long")}
    texts = docs.select("text")
    parts = blocks(benchmark, block)
    index = Index(next(parts, []), texts, window)  # an empty benchmark is one empty block
    shared = docs.sparkSession.sparkContext.broadcast(index)
    marked = docs.drop("_rank", "_hash").withColumns(start)
    keyed = marked.withColumns({"_rank": F.coalesce("doc_id", F.lit(-(2**63))), "_hash": F.xxhash64("_whole")})
    more = [further(keyed, Index(items, texts, window)) for items in parts]
    out = united(pass_block(keyed, shared), more).drop("_rank", "_hash") if more else pass_block(marked, shared)
    hit = F.aggregate(F.transform("_hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x).cast("long")
    out = out.withColumn("_n_hit", hit)
    return out.withColumn("_contaminated", (F.col("_n_hit") > 0) & (F.col("_n_hit") * 20 >= F.col("_n_words"))).drop("_whole")


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dwin.n, item_id FROM dwin JOIN win ON win.s = dwin.s AND win.n = dwin.n),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
