"""N-gram Jaccard self-join by universe partition and pigeonhole, with exact verification.

A document is the set of its distinct 5-word shingles. Sets with a Jaccard
similarity of at least 3/4 differ in at most H(s) = s // 3 shingles, s being
the size of either. Size bands double; a set signs in its own band, and in the
next where a partner may belong there. In a band the universe of shingles is
hashed into M segments, and a set's signature of a segment is the hash of its
shingles there.

Allocation by cost. A signature's cost is the number of different sets that have
it; one that more than COLD sets have (hot) is skipped. Contents decide, so both
sets of a pair skip alike. Every segment counts 0, 1 or 2 towards H + 1:

* Level 1. A non-empty segment counts 1 (equal contents needed), or 0 if hot. A
  set whose count reaches H + 1 meets each of its partners in some segment.
* Level 2. Sets for which level 1 falls short (copies in large groups, texts of
  common passages) sign again in half as many, larger segments: the contents
  and every one-deletion neighbour of them are indexed. A segment counts 2, or 1
  if a neighbour is hot, or 0 if its contents are.
* Level 3. Sets for which that falls short too sign single shingles, which are
  segments of one element.

A pair is found in a cold list at the first level at which one of the two does
not fall short. At level 1 a pair must share as many signatures as H leaves
equal. At level 3 a pair's cold common shingles and the smaller of the two
numbers of hot shingles must reach the overlap that the similarity needs.

What is left are pairs of level 3 whose common shingles are all hot: the core of
large groups of near copies. Both have hot shingles enough to be similar, so
each enters only the cheapest of its hot lists that the overlap makes necessary
(prefix order: length of list, shingle), and two members of a list are a pair
only if the shingles that both have left from there on are enough (rest). A list
isn't paired out. Its members are compared with its centre, the member with the
largest share of hot shingles, which is nearest to the group's common text; then
members not yet in one component with more leaders, four times as many a round,
while that finds links; last, those outside the centre's component with all. So
a group of near copies costs about one comparison per member, texts that differ
are kept apart by their own shingles, and no link between components is lost.
Every candidate is verified on both whole sets.

Sets of equal content are one class from the start. Signatures of level 1 travel
packed, 11 bytes each; truncated hashes can only add candidates.

Edge cases: null text and text without words have no shingles and no links;
fewer than five words make one shingle; repeated rows and exact copies are one
class; null doc_id sorts first; a very long text is one set, and two sets are
compared whole in one task; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, blob_buffer, constants, mix, runs, signed, skew_lookup, slices, staged, text_buffer
from .components import components, extended

SHINGLE = 5
#: A level-1 signature that more different sets share is skipped.
COLD = 6
SLACK = 1.3
#: Bytes of text per bucket of signatures.
BUCKET = 8 << 20
#: Signatures that a task holds before it sends them.
FLUSH = 1_200_000
#: Each round has 2 ** STEP times the leaders of the one before.
STEP = 2
U64 = np.uint64
_SEED = constants(91, 8)
ID_MASK = U64((1 << 40) - 1)


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, first entry of each text)."""
    words = Words(data, offsets, NOT_SPACE)
    h, doc, counts = words.hashes(), words.doc(), words.counts
    full = runs(h, k, 17)
    if len(full):
        good = doc[: len(full)] == doc[k - 1 :]
        full, owner = full[good], doc[: len(full)][good]
    else:
        owner = np.zeros(0, doc.dtype)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        more = np.array([mix(runs(h[words.first[d] : words.first[d + 1]], int(counts[d]), 17 + int(counts[d])))[0] for d in short], dtype=U64)
        full, owner = np.concatenate([full, more]), np.concatenate([owner, short])
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    if len(full):
        fresh = np.concatenate([[True], (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])])
        full, owner = full[fresh], owner[fresh]
    return full, np.searchsorted(owner, np.arange(len(offsets)))


def fingerprints(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ _SEED[0]))])
        size = np.diff(first)
        out = mix(total[first[1:]] - total[first[:-1]] + size.astype(U64) * _SEED[1])
    out[size == 0] = 0
    return out


def most_different(size: np.ndarray) -> np.ndarray:
    return size // 3


def bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, band): a set's own band, and the next one where a partner of up to 4/3 its size may be."""
    some = np.flatnonzero(size)
    own = np.floor(np.log2(size[some])).astype(np.int64)
    up = 4 * size[some] >= 3 * (2 << own)
    return np.concatenate([some, some[up]]), np.concatenate([own, own[up] + 1])


def expand(sets: np.ndarray, first: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of `sets`, index into `who`) for every element of the sets in `who`."""
    n = first[who + 1] - first[who]
    at = np.repeat(np.arange(len(who)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[who], n), at


def segments(sets, first, who, band, count, seed):
    """Non-empty segments of the sets in `who`: (index into who, segment, first element, elements sorted by segment)."""
    entry, at = expand(sets, first, who)
    x = sets[entry]
    with np.errstate(over="ignore"):
        seg = (mix(x ^ (_SEED[2] + band[at].astype(U64) * U64(seed))) % count[at].astype(U64)).astype(np.int64)
    key = at * (int(count.max()) + 1 if len(count) else 1) + seg
    order = np.argsort(key, kind="stable")
    key, x, at, seg = key[order], x[order], at[order], seg[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return at[begin], seg[begin], begin, x


def level_1(sets: np.ndarray, first: np.ndarray):
    """(set, signature) of all non-empty segments, and for each set how many it can spare before it falls short."""
    size = np.diff(first)
    who, band = bands(size)
    count = (SLACK * (2 << band) / 3).astype(np.int64) + 2
    at, seg, begin, x = segments(sets, first, who, band, count, 3)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix(x ^ _SEED[3]), begin) if len(begin) else np.zeros(0, U64)
        sig = mix(total + seg.astype(U64) * _SEED[4] + band[at].astype(U64) * _SEED[5])
    held = np.bincount(at, minlength=len(who))
    spare = np.full(len(size), 1 << 30)
    np.minimum.at(spare, who, held - most_different(size)[who] - 1)
    return who[at], sig, spare


def level_2(sets: np.ndarray, first: np.ndarray):
    """Columns set, band, segment, whole, spare, signature: larger segments and their one-deletion neighbours.

    spare is what the set's segments in the band count in all, beyond the H + 1 that is needed.
    """
    size = np.diff(first)
    who, band = bands(size)
    count = (most_different(2 << band) + 2) // 2
    at, seg, begin, x = segments(sets, first, who, band, count, 7)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none.astype(bool), none, np.zeros(0, U64)
    length = np.diff(np.append(begin, len(x)))
    worth = np.bincount(at, weights=np.minimum(length, 2), minlength=len(who)).astype(np.int64)
    spare = worth - most_different(size)[who] - 1
    with np.errstate(over="ignore"):
        value = mix(x ^ _SEED[6])
        total = np.add.reduceat(value, begin)
        base = seg.astype(U64) * _SEED[4] + band[at].astype(U64) * _SEED[7]
        of = np.repeat(np.arange(len(at)), length)
        less = mix(total[of] - value + base[of])
    several = length[of] > 1
    entry = np.concatenate([np.arange(len(at)), of[several]])
    whole = np.arange(len(entry)) < len(at)
    return who[at[entry]], band[at[entry]], seg[entry], whole, spare[at[entry]], np.concatenate([mix(total + base), less[several]])


# ---------------------------------------------------------------- passes


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, fp, size, spare of every document."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i, j, data, offsets in slices(*text_buffer(batch.column(names.index("text"))), 1 << 20):
                sets, first = shingle_sets(data, offsets, k)
                _, _, spare = level_1(sets, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index("doc_id"))[i:j], batch.column(names.index("text_hash"))[i:j], pa.array(signed(fingerprints(sets, first))), pa.array(np.diff(first)), pa.array(spare)],
                    names=["doc_id", "text_hash", "fp", "size", "spare"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long, size long, spare long")


def pack(sig: np.ndarray, ids: np.ndarray, buckets: int):
    """Rows (bucket, blob): the entries of each bucket as 6 bytes of signature and 5 of id, by columns."""
    bucket = (sig >> U64(32)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, sig, ids = bucket[order], sig[order], ids[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    columns = (sig.astype(np.uint32), (sig >> U64(32)).astype(np.uint16), ids.astype(np.uint32), (ids >> U64(32)).astype(np.uint8))
    ends = [*cut[1:], len(bucket)]
    return [int(bucket[c]) for c in cut], [b"".join(x[c:e].tobytes() for x in columns) for c, e in zip(cut, ends, strict=True)]


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sigs, ids = [], []
    for b in blobs:
        n, at, parts = len(b) // 11, 0, []
        for t in (np.uint32, np.uint16, np.uint32, np.uint8):
            parts.append(np.frombuffer(b, t, n, at).astype(U64))
            at += n * np.dtype(t).itemsize
        sigs.append(parts[0] | parts[1] << U64(32))
        ids.append(parts[2] | parts[3] << U64(32))
    return np.concatenate(sigs), np.concatenate(ids)


def groups(sig: np.ndarray, ids: np.ndarray):
    """Distinct (sig, id) sorted by both, with the first entry of each signature that has two or more ids."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    if len(sig):
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
        sig, ids = sig[keep], ids[keep]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(sig)))
    return sig, ids, begin, size


def signatures(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Packed level-1 signatures. A signature that COLD + 1 sets share within a task is known to be skipped there:
    its further members go out as counts only (bucket below 0), so a bucket gets few entries of it from each task."""

    def flush(sig, ids):
        sig, ids, begin, size = groups(np.concatenate(sig), np.concatenate(ids))
        rank = np.arange(len(sig)) - np.repeat(begin, size)
        over = rank > COLD
        names, blobs = pack(sig[~over], ids[~over], buckets)
        if over.any():
            counted, n = np.unique(ids[over], return_counts=True)
            for b in np.unique(counted % U64(buckets)):
                mine = counted % U64(buckets) == b
                names.append(-1 - int(b))
                blobs.append(counted[mine].tobytes() + n[mine].astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        sigs, ids, held, seen = [], [], 0, np.zeros(0, U64)
        for batch in batches:
            for _, _, data, offsets in slices(*text_buffer(batch.column(0)), 1 << 20):
                sets, first = shingle_sets(data, offsets, k)
                fp = fingerprints(sets, first)
                _, once = np.unique(fp, return_index=True)
                fresh = np.zeros(len(fp), dtype=bool)
                fresh[once] = ~np.isin(fp[once], seen)
                seen = np.concatenate([seen, fp[fresh]])
                who, sig, _ = level_1(sets, first)
                mine = fresh[who]
                sigs.append(sig[mine])
                ids.append(fp[who[mine]] & ID_MASK)
                held += len(sigs[-1])
                if held > FLUSH:
                    yield flush(sigs, ids)
                    sigs, ids, held = [], [], 0
        if held:
            yield flush(sigs, ids)

    return docs.select("text").mapInArrow(run, "bucket int, blob binary")


def cold_and_hot(table: pa.Table) -> pa.Table:
    """One bucket's pairs (a < b, n: shared signatures) of groups up to COLD, and for members of larger ones (a, b: null, n: how many)."""
    bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
    if bucket < 0:
        ids = np.concatenate([np.frombuffer(b, U64, len(b) // 16) for b in blobs])
        n = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])
        return pa.table({"a": pa.array(signed(ids)), "b": pa.nulls(len(ids), pa.int64()), "n": pa.array(n)})
    sig, ids, begin, size = groups(*unpack(blobs))
    left, right = [], []
    for m in range(2, COLD + 1):
        at = begin[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                left.append(ids[at + i])
                right.append(ids[at + j])
    left, right = [np.concatenate(x) if x else np.zeros(0, U64) for x in (left, right)]
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    cut = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, np.int64)
    shared = np.diff(np.append(cut, len(left)))
    hot, n = np.unique(ids[np.repeat(size > COLD, size)], return_counts=True)
    a = np.concatenate([left[cut], hot])
    b = pa.concat_arrays([pa.array(signed(right[cut])), pa.nulls(len(hot), pa.int64())])
    return pa.table({"a": pa.array(signed(a)), "b": b, "n": pa.array(np.concatenate([shared, n]).astype(np.int64))})


def load_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fp, size, elements (packed) for one document of each wanted class; rows repeated in docs repeat here, which does no harm."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_rank"), F.xxhash64("text").alias("_hash"), "text")
    found = keyed.join(wanted.select(F.col("rank").alias("_rank"), F.col("text_hash").alias("_hash"), "fp"), ["_rank", "_hash"])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i, j, data, offsets in slices(*text_buffer(batch.column(names.index("text"))), 1 << 20):
                sets, first = shingle_sets(data, offsets, k)
                blobs = [sets[first[d] : first[d + 1]].tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(names.index("fp"))[i:j], pa.array(np.diff(first)), pa.array(blobs, pa.binary())], names=["fp", "size", "elements"])

    return found.mapInArrow(run, "fp long, size long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity numerator / denominator, compared whole."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            a, b = [batch.column(names.index(c)).to_pylist() for c in ("left", "right")]
            good = []
            for x, y in zip(a, b, strict=True):
                n, m = len(x) // 8, len(y) // 8
                both = np.sort(np.concatenate([np.frombuffer(x, U64), np.frombuffer(y, U64)]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(denominator * same >= numerator * (n + m - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).filter(keep) for c in ("a", "b")], names=["a", "b"])

    small = sets.select(F.col("fp").alias("a"), F.col("elements").alias("left"))
    large = sets.select(F.col("fp").alias("b"), F.col("elements").alias("right"))
    return pairs.select("a", "b").join(small, "a").join(large, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- sets that level 1 can't serve


def entries(sets: DataFrame, neighbours: bool) -> DataFrame:
    """The signatures of level 2 (neighbours) or of level 3, a row each."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            fp = batch.column(names.index("fp")).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in slices(*blob_buffer(batch.column(names.index("elements"))), 2 << 20):
                x, first = np.frombuffer(data.tobytes(), U64), offsets // 8
                size = np.diff(first)
                if neighbours:
                    who, band, segment, whole, spare, sig = level_2(x, first)
                    more = [pa.array(band.astype(np.int32)), pa.array(segment.astype(np.int32)), pa.array(whole), pa.array(spare.astype(np.int32))]
                else:
                    who, sig, more = np.repeat(np.arange(j - i), size), x, []
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(fp[i:j][who]), pa.array(size[who].astype(np.int32)), *more], names=columns)

    columns = ["sig", "fp", "size", *(["band", "segment", "whole", "spare"] if neighbours else [])]
    schema = "sig long, fp long, size int" + (", band int, segment int, whole boolean, spare int" if neighbours else "")
    return staged(sets.select("fp", "elements").mapInArrow(run, schema), "entries")


def lists(found: DataFrame) -> DataFrame:
    """The entries whose signature several sets have, with n, how many."""
    counts = staged(found.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return staged(skew_lookup(found, counts, ["sig"], "n"), "lists")


def cold_pairs(listed: DataFrame) -> DataFrame:
    """a < b, na, nb, shared of all pairs of sets that share signatures of at most COLD sets; shared counts those."""
    together = listed.where(F.col("n") <= COLD).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("fp", "size"))).alias("of"))
    pairs = F.flatten(F.transform("of", lambda y, i: F.transform(F.slice("of", 1, i), lambda x: F.struct(x["fp"].alias("a"), y["fp"].alias("b"), x["size"].alias("na"), y["size"].alias("nb")))))
    return together.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "p.na", "p.nb").agg(F.count("*").alias("shared"))


def close(numerator: int, denominator: int, one: str = "na", two: str = "nb"):
    """Whether sizes let two sets be similar."""
    return denominator * F.least(one, two) >= numerator * F.greatest(one, two)


def enough(shared, numerator: int, denominator: int, one: str = "na", two: str = "nb"):
    """Whether so many common elements make sets of these sizes similar."""
    return (numerator + denominator) * shared >= numerator * (F.col(one) + F.col(two))


def deeper(sets: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b from cold lists of levels 2 and 3, members of hot lists: sig, fp, size, heat)."""
    found = entries(sets, True)
    listed = lists(found)
    pairs = cold_pairs(listed).where(close(numerator, denominator)).select("a", "b")
    lost = listed.where(F.col("n") > COLD).groupBy("fp", "band", "segment").agg(F.max(F.when(F.col("whole"), 2).otherwise(1)).alias("lost"))
    lost = lost.groupBy("fp", "band").agg(F.sum("lost").alias("lost"))
    held = found.groupBy("fp", "band").agg(F.first("spare").alias("spare")).join(lost, ["fp", "band"], "left")
    short = staged(held.where(F.col("spare") < F.coalesce("lost", F.lit(0))).select("fp").distinct(), "short")
    listed = lists(entries(sets.join(short, "fp", "left_semi"), False))
    hot = listed.where(F.col("n") > COLD).groupBy("fp", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("by_cost")).withColumn("heat", F.size("by_cost"))
    hot = staged(hot, "hot")
    heat = hot.select("fp", "heat")
    both = cold_pairs(listed).where(close(numerator, denominator))
    both = both.join(heat.select(F.col("fp").alias("a"), F.col("heat").alias("ha")), "a", "left").join(heat.select(F.col("fp").alias("b"), F.col("heat").alias("hb")), "b", "left")
    most = F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = pairs.union(both.where(enough(most, numerator, denominator)).select("a", "b"))
    listed = hot.select("fp", "size", "heat", F.posexplode("by_cost").alias("at", "x")).select("x.sig", "fp", "size", "heat", (F.col("heat") - F.col("at")).alias("rest"))
    listed = staged(listed.where(denominator * F.col("rest") >= numerator * F.col("size")), "members")
    smallest = staged(listed.groupBy("sig").agg(F.min("size").alias("least"), F.count("*").alias("n")).where("n > 1"), "smallest")
    members = skew_lookup(listed, smallest, ["sig"], "n").where(enough(F.col("rest"), numerator, denominator, "size", "least"))
    return pairs, staged(members.select("sig", "fp", "size", "heat", "rest"), "members")


def leads(shift: int):
    """Whether a member of a list leads when so many times twice as many as at first do."""
    level = F.greatest(F.ceil(F.log2("n")) - shift, F.lit(0)).cast("int")
    return F.pmod(F.xxhash64("fp"), F.pow(F.lit(2.0), level).cast("long")) == 0


def settled(members: DataFrame, links: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """links with those between members of one hot list that components need.

    Rounds of leaders go on while they find links. Then members outside the
    component of their list's centre meet all of the list, which is the rest.
    """
    labels, shift, last = components(links), 0, False
    fields = ("fp", "size", "rest", "label")
    while True:
        named = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        named = staged(named, "named")
        centre = F.max(F.struct((F.col("heat") / F.col("size")).alias("purity"), *fields)).alias("centre")
        open_ = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), centre).where("low <> high").drop("low", "high")
        open_ = staged(open_, "open")
        if not open_.take(1):
            return links
        here = staged(skew_lookup(named, open_, ["sig"], "n"), "members")
        lead = lambda of="": [F.col(f"{of}{x}").alias("lead" if x == "fp" else f"lead_{x}") for x in fields]
        if last:
            met = here.join(here.where("label <> centre.label").select("sig", *lead()), "sig")
        elif shift:  # what led in an earlier round has met the whole list
            before = leads(shift - STEP) if shift > STEP else F.lit(False)
            met = here.where(~before).join(here.where(leads(shift) & ~before).select("sig", *lead()), "sig")
        else:  # the member that is nearest to what its lists have in common
            met = here.select(*fields, *lead("centre."))
        apart = (F.col("label") != F.col("lead_label")) & close(numerator, denominator, "size", "lead_size")
        met = met.where(apart & enough(F.least("rest", "lead_rest"), numerator, denominator, "size", "lead_size"))
        fresh = staged(met.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct(), "pairs")
        more = staged(verified(fresh, sets, numerator, denominator), "links")
        links = links.union(more)
        if last:
            return links
        if more.take(1):
            labels = extended(labels, more)
        else:
            last = shift > 0
        members = here.select("sig", "fp", "size", "heat", "rest")
        shift += STEP


def similar(docs: DataFrame, k: int = SHINGLE, numerator: int = 3, denominator: int = 4) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, text_hash, fp, size, class_id per row; and a, b: classes linked (those needed for components)."""
    if (numerator, denominator) != (3, 4):
        raise ValueError("bounds of segments are set for a similarity of 3/4")
    rank = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = staged(describe(docs, k), "sets")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET))
    classes = rows.where("size > 0").groupBy("fp").agg(F.min(F.struct(rank.alias("rank"), "text_hash")).alias("one"), F.first("size").alias("size"), F.first("spare").alias("spare"), F.count("*").alias("copies"))
    classes = staged(classes.select("fp", "one.rank", "one.text_hash", "size", "spare", "copies", F.col("fp").bitwiseAND(F.lit((1 << 40) - 1)).alias("id")), "classes")
    found = staged(signatures(docs, k, buckets).groupBy("bucket").applyInArrow(cold_and_hot, "a long, b long, n long"), "candidates")
    hot = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("hot"))
    # A set's partners differ in at most H of its segments, so they share all its others that are not skipped.
    ids = classes.join(hot, "id", "left").select("id", "fp", F.col("size").alias("n"), (F.col("spare") - F.coalesce("hot", F.lit(0)) + 1).alias("least"))
    ids = staged(ids, "ids")
    short = staged(ids.where("least <= 0").select("fp"), "short")
    cold = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    one = ids.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("least").alias("la"))
    two = ids.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("least").alias("lb"))
    fits = (denominator * F.least("na", "nb") >= numerator * F.greatest("na", "nb")) & (F.col("shared") >= F.greatest("la", "lb"))
    pairs = cold.join(one, "a").join(two, "b").where(fits).select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    pairs = staged(pairs.where("a <> b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(short).distinct().join(classes, "fp")
    sets = staged(load_sets(docs, wanted, k), "elements")
    if not short.take(1):
        return rows, staged(verified(pairs, sets, numerator, denominator), "links")
    further, members = deeper(sets.join(short, "fp", "left_semi"), numerator, denominator)
    pairs = staged(pairs.union(further).distinct(), "pairs")
    links = staged(verified(pairs, sets, numerator, denominator), "links")
    links = settled(members, links, sets, numerator, denominator)
    return rows, links


def clusters(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable by links, its own included) of every row."""
    rank = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows, links = similar(docs, k)
    classes = rows.where("size > 0").groupBy("fp").agg(F.min(rank).alias("own"), F.count("*").alias("copies"))
    labels = components(links)
    joined = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = staged(joined, "classes")
    lowest = joined.groupBy("label").agg(F.min("own").alias("component"))
    table = staged(joined.join(lowest, "label").select("fp", "component", "copies"), "components")
    several = skew_lookup(rows.where("size > 0"), table, ["fp"], "copies").select("doc_id", "text_hash", "size", "component")
    alone = rows.where("size = 0").select("doc_id", "text_hash", "size", rank.alias("component"))
    out = several.unionByName(alone)
    return out.select("doc_id", "text_hash", F.col("size").alias("n_shingles"), F.nullif(F.col("component"), F.lit(-(2**63))).alias("component_id"))


def op5(docs: DataFrame) -> DataFrame:
    return clusters(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def brute(rows: list[tuple[int, str]], k: int = SHINGLE) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), from all pairs that share a shingle. For tests."""
    import re

    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    common: dict = {}
    for d, s in sets.items():
        count: dict = {}
        for x in s:
            for e in holders[x]:
                if e > d:
                    count[e] = count.get(e, 0) + 1
        common.update({(d, e): n for e, n in count.items()})
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = d = parent[parent[d]]
        return d

    for (d, e), n in common.items():
        if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
            a, b = sorted((root(d), root(e)))
            parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}
