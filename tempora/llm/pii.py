"""PII: pattern matches plus information-theoretic sanitisation of the terms that go with them.

Base patterns find entities (email, ip, card, phone). Terms are the words
outside base matches, anywhere in a text. Over the whole corpus, with N
documents, c(t) documents that hold a term, c(e) that hold an entity and c(e, t)
that hold both:

    information(e) = log(N / c(e))           pointwise(e, t) = log(N c(e, t) / (c(e) c(t)))
    disclosure(e, t) = pointwise / information

Disclosure is 1 for a term that stands in no document but the entity's, and near
0 for a word that stands everywhere. Of the pairs found in at least SUPPORT
documents, a term is removed over REMOVE and generalised over GENERALISE, by the
largest disclosure of any entity, at all its places in all documents. Spans of
base matches are never changed by this.

What moves: the texts pass through Python three times. First come combined
document counts of entities and terms; then combined counts of the pairs of
entities found in SUPPORT documents, as no other pair can reach it; then base
matches and the places of disclosing terms. The second and third pass know the
keys they look for by a bit set of at most 4 MB, which lets too many through
but loses none; exact joins decide, or in the third pass the disclosing terms
themselves, which go to the workers if there are at most TRAVEL of them. Texts
are never shuffled.

Edge cases: null text is empty; every input row gives one row, repeated rows
too (each counts as a document); null doc_id is kept; further columns are
ignored by op1, and redact replaces one named clean_text; of overlapping spans the
first is redacted; very long texts are worked on whole, a task holding one at a
time; a corpus without entities gives base results only, an empty one no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, digest_spans, signed, skew_lookup, slices, staged, text_buffer

# Kinds in the order in which they are listed; the method's own kinds follow.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "generalise", "remove"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SUPPORT = 2
GENERALISE = 0.6
REMOVE = 0.85
MOST_BITS = 25  # of an index into a bit set
HELD = 1_000_000
TRAVEL = 2_000_000  # disclosing terms that workers hold whole, 18 MB; more are joined
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping emails. Each @ decides alone: a local part can't pass an earlier @ or match."""
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and low > 0 and text[low - 1] in _LOCAL_SET:
            low -= 1
        m = DOMAIN.match(text, at) if low < at else None
        if m:
            yield low, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", at + 1)


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of every base match that passes its test."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, kind: int) -> int:
    value = text.lower() if kind == 0 else "".join(DIGITS.findall(text)) if kind > 1 else text
    return int.from_bytes(hashlib.blake2b(f"{BASE[kind]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


COUNTS = "what int, key long, n long"
DOCUMENT, ENTITY, TERM = range(3)
PAIRS = "entity long, term long, together long"
ROWS = "doc_id long, text_hash long, spans array<int>, marks array<struct<start:int,what:long,end:int>>"
TERMS = "array<struct<start:int,kind:int,end:int>>"
_MARKS = pa.list_(pa.struct([("start", pa.int32()), ("what", pa.int64()), ("end", pa.int32())]))


def combined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def document_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a run of texts and in how many of the texts each stands."""
    h, doc = words.hashes(), words.doc()
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    if not len(h):
        return h, np.zeros(0, np.int64)
    fresh = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(fresh)
    pair = fresh | np.concatenate([[True], doc[1:] != doc[:-1]])
    return h[first], np.add.reduceat(pair.astype(np.int64), first)


def entities(text: str | None) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Base matches of a text and its distinct entities."""
    found = base_spans(text) if text else []
    return found, sorted({entity(text[s:e], k) for s, k, e in found})


def outside(found: list[tuple[int, int, int]], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the spans first..last touch no base match."""
    if not found:
        return np.ones(len(first), dtype=bool)
    starts = np.array([s for s, _, _ in found])
    ends = np.maximum.accumulate(np.array([e for _, _, e in found]))  # ends[i]: where the matches up to the i-th reach
    before = np.searchsorted(starts, last)
    return (before == 0) | (ends[before - 1] <= first)


def code_points(data: np.ndarray) -> np.ndarray:
    """Byte -> number of code points that begin before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def counts(batches):
    """Rows (what, key, n): the number of documents, and in how many each entity and each term stands; keys may repeat."""
    documents = 0
    for what, keys, n in _counts(batches):
        if what == DOCUMENT:
            documents += n
            continue
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), what, np.int32)), pa.array(keys), pa.array(n)], names=["what", "key", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([DOCUMENT], pa.int32()), pa.array([0], pa.int64()), pa.array([documents], pa.int64())], names=["what", "key", "n"])


def _counts(batches):
    parts, held = [], 0
    for batch in batches:
        column = batch.column(batch.schema.names.index("text"))
        found = np.array([x for text in column.to_pylist() for x in entities(text)[1]], np.int64)
        yield DOCUMENT, None, batch.num_rows
        if len(found):
            yield ENTITY, *np.unique(found, return_counts=True)
        for _, _, data, offsets in slices(*text_buffer(column)):
            parts.append(document_counts(Words(data, offsets, ALNUM)))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [combined(parts)]
                if len(parts[0][0]) > HELD * 3 // 4:
                    yield TERM, signed(parts[0][0]), parts[0][1]
                    parts = []
                held = sum(len(p[0]) for p in parts)
    if parts:
        keys, n = combined(parts)
        yield TERM, signed(keys), n


def bit_set(keys: DataFrame, column: str) -> np.ndarray:
    """A bit set by the low bits of the keys, about 64 bits for each key up to 2^MOST_BITS."""
    bits = min(MOST_BITS, max(10, keys.count().bit_length() + 6))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast({column} & 63L AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a bit set."""
    at = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def pair_counts(bits: np.ndarray):
    """Rows (entity, term, together) of the entities in a bit set: combined document counts, pairs may repeat."""

    def record(pairs):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["entity", "term", "together"])

    def combine(parts):
        who, term, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((term, who))
        who, term, n = who[order], term[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (term[1:] != term[:-1])]))
        return who[first], term[first], np.add.reduceat(n, first)

    def work(batches):
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                found, own = entities(text)
                own = np.array(own, np.int64)
                own = own[among(bits, own.view(np.uint64))]
                if not len(own):
                    continue
                words = Words(*text_buffer(pa.array([text])), ALNUM)
                cp = code_points(words.data)
                terms = np.unique(signed(words.hashes())[outside(found, cp[words.start], cp[words.end])])
                if not len(terms):
                    continue
                for who in own:
                    parts.append((np.full(len(terms), who), terms, np.ones(len(terms), np.int64)))
                    held += max(len(terms), 32)  # small arrays weigh too
                    if held > HELD:
                        parts = [combine(parts)]
                        if len(parts[0][0]) > HELD * 3 // 4:
                            yield record(parts[0])
                            parts = []
                        held = sum(len(p[0]) for p in parts)
        if parts:
            yield record(combine(parts))

    return work


def places(bits: np.ndarray, told: tuple[np.ndarray, np.ndarray] | None):
    """A row for each document: base matches, and marks at the places outside them of the terms in a bit set.

    With told, the sorted terms and their kinds, marks are those terms' only and give the kind, else the term.
    """

    def work(batches):
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("text"))
            found = [base_spans(text) if text else [] for text in column.to_pylist()]
            size, out = np.zeros(batch.num_rows, np.int64), []
            for i, _, data, offsets in slices(*text_buffer(column)):
                words = Words(data, offsets, ALNUM)
                h = words.hashes()
                hit = np.flatnonzero(among(bits, h))
                what = signed(h[hit])
                if told and len(hit):
                    at = np.minimum(np.searchsorted(told[0], what), len(told[0]) - 1)
                    same = told[0][at] == what
                    hit, what = hit[same], told[1][at[same]]
                if not len(hit):
                    continue
                cp, doc = code_points(data), words.doc()[hit]
                zero = cp[offsets[doc]]
                first, last = cp[words.start[hit]] - zero, cp[words.end[hit]] - zero
                good = np.ones(len(hit), dtype=bool)
                ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if found[i + doc[a]]:
                        good[a:b] = outside(found[i + doc[a]], first[a:b], last[a:b])
                size += np.bincount(i + doc[good], minlength=batch.num_rows)
                out.append((first[good], what[good], last[good]))
            first, what, last = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            marks = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(what, pa.int64()), pa.array(last, pa.int32())], fields=list(_MARKS.value_type))
            marks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), marks, type=_MARKS)
            spans = pa.array([[x for s in f for x in s] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("text_hash")), spans, marks], names=["doc_id", "text_hash", "spans", "marks"])

    return work


def weighted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table, of its keys in rows, with their number of rows there as `weight`."""
    return table.join(rows.groupBy(key).agg(F.count("*").alias("weight")), key)


def disclosure(pairs: DataFrame, found: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """entity, term, disclosure of pairs (entity, term, together), by found (entity, with_entity) and terms (term, with_term)."""
    known = staged(skew_lookup(pairs, staged(weighted(found, pairs, "entity"), "pii-entities"), ["entity"], "weight").drop("weight"), "pii-known")
    known = skew_lookup(known, staged(weighted(terms, known, "term"), "pii-terms"), ["term"], "weight")
    n = F.lit(float(max(documents, 1)))
    information = F.log(n / F.col("with_entity"))
    pointwise = F.log(n * F.col("together") / (F.col("with_entity") * F.col("with_term")))
    return known.select("entity", "term", F.when(information > 0, F.least(F.lit(1.0), pointwise / information)).otherwise(F.lit(0.0)).alias("disclosure"))


def disclosing(docs: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """term, kind of every term that discloses an entity."""
    seen = staged(docs.select("text").mapInArrow(counts, COUNTS), "pii-counts")
    count = lambda what, key, n: seen.where(F.col("what") == what).groupBy(F.col("key").alias(key)).agg(F.sum("n").alias(n))
    documents = count(DOCUMENT, "key", "n").first()
    found = staged(count(ENTITY, "entity", "with_entity").where(F.col("with_entity") >= support), "pii-found")
    pairs = docs.select("text").mapInArrow(pair_counts(bit_set(found, "entity")), PAIRS)
    pairs = staged(pairs.groupBy("entity", "term").agg(F.sum("together").alias("together")).where(F.col("together") >= support), "pii-pairs")
    told = disclosure(pairs, found, count(TERM, "term", "with_term"), documents.n if documents else 0).where(F.col("disclosure") >= generalise)
    kind = F.when(F.col("disclosure") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    return staged(told.groupBy("term").agg(F.max(kind).alias("kind")), "pii-disclosing")


def pii_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text_hash, spans (flat start, kind, end of base matches) and terms (start, kind, end) of each document."""
    told = disclosing(docs, support, generalise, remove)
    texts, bits = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), bit_set(told, "term")
    if told.count() <= TRAVEL:
        whole = told.toArrow().sort_by("term")
        rows = texts.mapInArrow(places(bits, (whole["term"].to_numpy(), whole["kind"].to_numpy().astype(np.int8))), ROWS)
        rows = staged(rows, "pii-rows")  # so that no task has the workers of two steps
        return rows.select("doc_id", "text_hash", "spans", F.col("marks").cast(TERMS).alias("terms"))
    rows = staged(texts.mapInArrow(places(bits, None), ROWS).select(F.monotonically_increasing_id().alias("row"), "*"), "pii-rows")
    near = rows.where(F.size("marks") > 0).select("row", F.explode("marks").alias("x")).select("row", "x.start", F.col("x.what").alias("term"), "x.end")
    found = skew_lookup(near, staged(weighted(told, near, "term"), "pii-told"), ["term"], "weight")
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("terms"))
    return rows.join(lists, "row", "left").select("doc_id", "text_hash", "spans", "terms")


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with clean_text: base matches and disclosing terms replaced by [KIND], generalised ones by their shape."""
    docs = docs.drop("clean_text", "_id", "_hash", "_spans", "_terms")
    spans = pii_spans(docs, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans", "terms").dropDuplicates(["_id", "_hash"])
    spans = spans.select("_id", "_hash", F.col("spans").alias("_spans"), F.col("terms").alias("_terms"))
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(docs["text"]) == spans["_hash"]), "left").drop("_id", "_hash")
    columns = docs.columns
    schema = rows.select(*columns).schema.add("clean_text", "string")

    def work(batches):
        for batch in batches:
            names = batch.schema.names
            out = []
            for text, flat, terms in zip(*[batch.column(names.index(c)).to_pylist() for c in ("text", "_spans", "_terms")], strict=True):
                marks = [*zip((flat or [])[::3], (flat or [])[1::3], (flat or [])[2::3], strict=True), *((t["start"], t["kind"], t["end"]) for t in terms or [])]
                parts, at = [], 0
                for s, k, e in sorted(marks):
                    if s < at:
                        continue
                    word = text[s:e]
                    parts += [text[at:s], f"[{len(word)} letters]" if KINDS[k] == "generalise" else f"[{KINDS[k].upper()}]"]
                    at = e
                out.append("".join([*parts, (text or "")[at:]]))
            keep = [batch.column(names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.string())], names=[*columns, "clean_text"])

    return rows.mapInArrow(work, schema)


def op1(docs: DataFrame) -> DataFrame:
    found = pii_spans(docs.select("doc_id", "text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_generalise long, n_remove long"

    def work(batches):
        for batch in batches:
            names, out = batch.schema.names, []
            for flat, terms in zip(batch.column(names.index("spans")).to_pylist(), batch.column(names.index("terms")).to_pylist(), strict=True):
                base = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
                more = [(t["start"], t["kind"], t["end"]) for t in terms or []]
                n = np.bincount([k for _, k, _ in base + more], minlength=len(KINDS)).tolist()
                out.append((*n[:4], hashlib.sha256(digest_spans(base, KINDS).encode()).hexdigest(), digest_spans(base + more, KINDS), *n[4:]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("doc_id"))] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_generalise", "n_remove"],
            )

    return found.mapInArrow(work, schema)
