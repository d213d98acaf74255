"""Substring dedup over sliding sentence spans.

A text is cut into sentences (after . ! ? before a blank, and at line ends).
A span is a run of consecutive sentences: three or more with at least MIN_WORDS
words together, or fewer that reach LONG_WORDS words. Spans are compared by
their words only (A-Z lowered, punctuation ignored). Of equal spans anywhere in
the corpus the first, by smallest doc_id and then position, stays; every
sentence covered by any other is removed.

Only the shortest span from each sentence and the shortest up to each sentence
are compared. What holds a span is a span, so these cover every longer one that
repeats, sentence by sentence: around a sentence take the smallest span inside
the longer one; it starts or ends there, or gets too short without its first
sentence as without its last. It repeats with the longer one and in the same
order, so the same sentences are removed as by comparing all spans.

What is shuffled: one small row per span, combined into (count, first place)
before its shuffle; spans found once go no further. Texts are shuffled once,
to meet the spans to remove.

Edge cases: null or empty text has no sentences and stays empty; a place is
(doc_id, text, sentence), null doc_id first, so of rows that share doc_id but not
text one keeps a repeated span, and rows that share both are one place and all
keep it; a very long text is worked on whole, a task holding one at a time; an
empty table gives an empty one; further columns come through unchanged, but
those named as the operator's own are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, NOT_SPACE, Words, constants, mix, signed, skew_lookup, slices, staged, text_buffer

RUN = 3
MIN_WORDS = 20
LONG_WORDS = 40
SPAN_SCHEMA = "h1 long, h2 int, doc_id long, text_hash long, first int, last int"
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Sentences with words in a run of texts: (text number, first byte, end byte, first word, end word, words)."""
    words = Words(data, offsets, ALNUM)
    n = len(data)
    blank = np.ones(n + 1, dtype=bool)
    blank[:n] = ~NOT_SPACE[data]
    ends = (_STOP[data] & blank[1:]) | (data == 10)
    cuts = np.unique(np.concatenate([np.flatnonzero(ends) + 1, offsets]))
    piece = np.searchsorted(cuts, words.start, side="right") - 1
    fresh = np.ones(len(piece), dtype=bool)
    fresh[1:] = piece[1:] != piece[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(piece))
    doc = words.doc()[first] if len(first) else np.zeros(0, np.int64)
    begin = cuts[piece[first]] if len(first) else np.zeros(0, np.int64)
    end = np.empty(len(first), np.int64)  # up to the next sentence, so that what stands between goes with this one
    if len(first):
        end[:-1] = begin[1:]
        end[-1] = n
        border = np.ones(len(first), dtype=bool)
        border[:-1] = doc[1:] != doc[:-1]
        end[border] = offsets[doc[border] + 1]
    return doc, begin, end, first, last, words


def spans(doc: np.ndarray, size: np.ndarray, run: int, fewest: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence (inclusive) of the shortest span from and up to each sentence that has one."""
    n = len(doc)
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(n)
    by_words = np.searchsorted(total, total[:-1] + fewest)  # end sentences that reach so many words
    by_long = np.searchsorted(total, total[:-1] + long)
    end = np.minimum(np.maximum(by_words, at + run), by_long)
    limit = np.searchsorted(doc, doc, side="right")
    good = (end <= limit) & (end > at)
    up_to = at + 1
    from_words = np.searchsorted(total, total[1:] - fewest, side="right") - 1
    from_long = np.searchsorted(total, total[1:] - long, side="right") - 1
    begin = np.maximum(np.minimum(from_words, up_to - run), from_long)
    more = begin >= np.searchsorted(doc, doc)
    more[more] = end[begin[more]] != up_to[more]  # not the shortest from its first sentence, which is there already
    return np.concatenate([at[good], begin[more]]), np.concatenate([end[good], up_to[more]]) - 1


def occurrences(docs: DataFrame, run: int, fewest: int, long: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("text_hash")
            for i, _, data, offsets in slices(*text_buffer(batch.column("text"))):
                doc, _, _, first, last, words = sentences(data, offsets)
                if not len(doc):
                    continue
                out = []
                a, b = spans(doc, last - first, run, fewest, long)
                if not len(a):
                    continue
                for which in (0, 1):  # a second, independent hash makes false matches out of reach
                    h = words.hashes(which)
                    weight = constants(31 + which, 4096)
                    # Horner's rule over a span's words as differences of running sums with powers of an odd number
                    out.append(_span_hash(h, first[a], last[b], int(weight[0])))
                at = pa.array(i + doc[a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(out[0])), pa.array(out[1].astype(np.uint32).view(np.int32)), ids.take(at), marks.take(at), pa.array(a - np.searchsorted(doc, doc[a]), pa.int32()), pa.array(b - np.searchsorted(doc, doc[a]), pa.int32())],
                    names=["h1", "h2", "doc_id", "text_hash", "first", "last"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, SPAN_SCHEMA)


def _span_hash(h: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    n = len(h)
    with np.errstate(over="ignore"):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        q = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        q[0] = 1
        q = np.multiply.accumulate(q)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:n])])
        return mix((total[end] - total[first]) * q[first] + (end - first).astype(np.uint64))


def repeated_spans(docs: DataFrame, run: int = RUN, fewest: int = MIN_WORDS, long: int = LONG_WORDS) -> DataFrame:
    """Every span that is not the first of its kind: doc_id, text_hash, first, last, and the first one's doc_id as source_id."""
    held = staged(occurrences(docs, run, fewest, long), "spans")
    rank = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    place = F.struct(rank.alias("d"), F.col("text_hash").alias("h"), F.col("first").alias("p"))
    seen = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where("n > 1")
    found = skew_lookup(held, staged(seen, "repeated"), ["h1", "h2"], "n")
    return found.where(place != F.col("origin")).select(rank.alias("_rank"), F.col("text_hash").alias("_hash"), "first", "last", F.col("origin.d").alias("source_id"))


def substring_dedup(docs: DataFrame, run: int = RUN, fewest: int = MIN_WORDS, long: int = LONG_WORDS) -> DataFrame:
    """docs with kept_text, _n_sentences, _n_removed, _n_words_removed and _sources (smallest doc_ids that hold first copies)."""
    docs = docs.drop("kept_text", "_n_sentences", "_n_removed", "_n_words_removed", "_source", "_drops", "_rank", "_hash")
    drops = repeated_spans(docs, run, fewest, long).groupBy("_rank", "_hash").agg(F.collect_set(F.struct("first", "last")).alias("_drops"), F.min("source_id").alias("_source"))
    rows = docs.withColumns({"_rank": F.coalesce("doc_id", F.lit(-(2**63))), "_hash": F.xxhash64("text")}).join(drops, ["_rank", "_hash"], "left").drop("_rank", "_hash")
    schema = rows.drop("_drops").schema.add("kept_text", "string").add("_n_sentences", "long").add("_n_removed", "long").add("_n_words_removed", "long")

    def work(batches):
        for batch in batches:
            names = batch.schema.names
            drop = batch.column(names.index("_drops"))
            n = batch.num_rows
            counts, removed, lost, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            for i, j, data, offsets in slices(*text_buffer(batch.column(names.index("text")))):
                doc, begin, end, first, last, _ = sentences(data, offsets)
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                counts[i:j] = np.diff(bounds)
                raw = data.tobytes()
                for d in range(j - i):
                    lists = drop[i + d].as_py()
                    whole = raw[offsets[d] : offsets[d + 1]]
                    if lists:
                        gone = np.zeros(bounds[d + 1] - bounds[d] + 1, np.int64)
                        for x in lists:
                            gone[x["first"]] += 1
                            gone[x["last"] + 1] -= 1
                        gone = np.cumsum(gone)[:-1] > 0
                        own = slice(bounds[d], bounds[d + 1])
                        removed[i + d], lost[i + d] = gone.sum(), (last[own] - first[own])[gone].sum()
                        b, e, at, parts = begin[own][gone], end[own][gone], int(offsets[d]), []
                        for s, t in zip(b.tolist(), e.tolist(), strict=True):
                            parts.append(raw[at:s])
                            at = t
                        whole = b"".join([*parts, raw[at : offsets[d + 1]]])
                    kept[i + d] = whole.decode()
            new = [pa.array(kept, pa.string()), pa.array(counts), pa.array(removed), pa.array(lost)]
            same = [(c, batch.column(k)) for k, c in enumerate(names) if c != "_drops"]
            yield pa.RecordBatch.from_arrays([x for _, x in same] + new, names=[c for c, _ in same] + ["kept_text", "_n_sentences", "_n_removed", "_n_words_removed"])

    return rows.mapInArrow(work, schema)


def op4(docs: DataFrame) -> DataFrame:
    out = substring_dedup(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_sentences").alias("n_sentences"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_words_removed").alias("n_words_removed"),
        F.col("_source").alias("source_id"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def brute(rows: list[tuple[int, str]], run: int = RUN, fewest: int = MIN_WORDS, long: int = LONG_WORDS) -> dict[int, tuple[int, int, str]]:
    """The same result in plain Python: doc_id -> (sentences, removed, digest of the kept text). For tests."""
    import re

    cut = {}
    for d, t in rows:
        t, parts, at = t or "", [], 0
        bounds = [m.end() for m in re.finditer(r"[.!?](?=[\x20\x09-\x0D]|$(?![\s\S]))|\n", t)]
        for b in [*dict.fromkeys(bounds), len(t)]:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t[at:b])
            if w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
                parts.append([at, b, tuple(w)])
                at = b
            elif parts:
                at = b
            else:
                at = b
        for k in range(len(parts) - 1):
            parts[k][1] = parts[k + 1][0]
        if parts:
            parts[-1][1] = len(t)
        cut[d] = (t, parts)
    seen: dict = {}
    for d in sorted(cut):
        parts = cut[d][1]
        for i in range(len(parts)):
            w: tuple = ()
            for j in range(i, len(parts)):
                w += parts[j][2]
                if (j - i + 1 >= run and len(w) >= fewest) or len(w) >= long:
                    seen.setdefault(w, []).append((d, i, j))
    gone: dict = {d: set() for d in cut}
    for places in seen.values():
        for d, i, j in sorted(places)[1:]:
            gone[d].update(range(i, j + 1))
    out = {}
    for d, (t, parts) in cut.items():
        keep, at = [], 0
        for k, (b, e, _) in enumerate(parts):
            if k in gone[d]:
                keep.append(t[at:b])
                at = e
        out[d] = (len(parts), len(gone[d]), hashlib.sha256("".join([*keep, t[at:]]).encode()).hexdigest())
    return out
