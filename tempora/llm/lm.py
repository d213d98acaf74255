"""LM scoring with a weighted backoff automaton over n-grams (Dirichlet smoothing).

States are the histories of up to ORDER - 1 tokens seen in training, the start
of a text being one of them, and the root (no history). With c the training
counts and h' a history h without its first token,

    p(w | h) = (c(h, w) + MU p(w | h')) / (c(h) + MU),   p(w) = (c(w) + 1) / (N + V + 1).

From state h an arc for w carries log10 p(w | h) where (h, w) was seen; where it
was not, the failure arc to h' carries log10 (MU / (c(h) + MU)), and so on down
to the root, which has an arc for every w. A text is walked once from left to
right: the state carried to a token is the longest history that was seen, as
many failure arcs are taken as there is no arc for the token, and weights are
added up. This smoothing needs no count but those of n-grams themselves (that
of a history is its count as an n-gram), so no history has to be gathered in
one place, however many continuations it has.

Nothing grows with the corpus in any one place. Texts are dealt into blocks of
about BLOCK bytes by a hash. Each block sends its distinct n-grams with their
training counts to buckets, which are ranges of n-gram hashes; each bucket adds
them up over all blocks and sends back, to each block and in the block's own
order, the counts of the whole corpus, with its own share of N and V; the block
then builds its part of the automaton and walks its texts. An n-gram is sent
once a block, so a common one takes no more room than a rare one. Every n-gram
is counted, none is pruned. N-grams are told by their length and 58 bits of a
hash.

Edge cases: null text is empty and has only its end token; null doc_id counts
as the empty string when documents are dealt to training; repeated rows are
scored and counted each; without training tokens all counts are 0 and
p = 1 / (V + 1) = 1; a very long text is walked whole in its block; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, constants, mix, slices, text_buffer

ORDER = 3
#: Weight of the shorter history's distribution, in tokens; of 1, 4, 16, 64 and 256 the best on held-out texts.
MU = 64.0
BLOCK = 12 << 20
#: Bits of an n-gram's key: a hash, and two for the length less one.
BITS = 60
U64 = np.uint64
START, END = U64(0xA5A5_0F0F_1234_5601), U64(0x5A5A_F0F0_4321_6503)
TIMES = constants(307, 5)


def keyed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Keys of n-grams of k + 1 tokens."""
    return (hashes >> U64(66 - BITS) << U64(2)) | U64(k)


#: Hash of the start of a text, which is a history but no token.
with np.errstate(over="ignore"):
    ORIGIN = mix(np.array([START]) * TIMES[0])


def training(doc_id) -> object:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 != 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, each ended by END; first token of each text)."""
    out, counts = [], []
    for _, _, data, offsets in slices(*text_buffer(column)):
        words = Words(data, offsets, NOT_SPACE)
        out.append(np.insert(words.hashes(), words.first[1:], END))
        counts.append(words.counts + 1)
    if not out:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and each entry's place among them: one sort of top bits and positions packed together."""
    n = len(keys)
    bits = max(n.bit_length(), 64 - BITS)
    packed = keys >> U64(bits - (64 - BITS)) << U64(bits)
    packed |= np.arange(n, dtype=U64)
    packed.sort()
    order = (packed & U64((1 << bits) - 1)).astype(np.int32)
    k = keys[order]
    for i in np.flatnonzero(k[1:] < k[:-1]).tolist():  # different keys with the same top bits
        top = packed[i] >> U64(bits) << U64(bits)
        x, y = np.searchsorted(packed, top), np.searchsorted(packed, top | U64((1 << bits) - 1), side="right")
        by = np.argsort(k[x:y], kind="stable")
        order[x:y], k[x:y] = order[x:y][by], k[x:y][by]
    del packed
    fresh = np.append(True, k[1:] != k[:-1])
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return k[fresh], place


class Block:
    """A block's texts as tokens, and its distinct n-grams in the order of their keys.

    gram[k] holds, for every token, the place of the n-gram of k + 1 tokens that
    ends there, -1 where the text (with its start) has fewer.
    """

    def __init__(self, column: pa.Array, train: np.ndarray, order: int):
        token, self.first = tokens(column)
        self.begin = self.first[:-1]
        level, inside = mix(token * TIMES[0]), np.ones(len(token), bool)
        keys, whole = [keyed(level, 0)], [inside]
        for k in range(1, order):
            level, inside = np.roll(level, 1), np.roll(inside, 1)
            level[self.begin], inside[self.begin] = ORIGIN[0], k == 1
            with np.errstate(over="ignore"):
                level = mix(level * TIMES[k] + token)
            keys.append(keyed(level[inside], k))
            whole.append(inside)
        keys.append(keyed(ORIGIN, 0))
        together = np.concatenate(keys)
        del token, level, keys
        self.keys, place = distinct(together)
        del together
        self.origin, at = place[-1], 0
        counted = np.repeat(train, np.diff(self.first))
        self.count = np.zeros(len(self.keys), np.int64)
        self.count[self.origin] = np.count_nonzero(train)
        self.gram = []
        for inside in whole:
            own = np.full(len(inside), -1, np.int32)
            n = np.count_nonzero(inside)
            own[inside] = place[at : at + n]
            at += n
            self.count += np.bincount(own[inside & counted], minlength=len(self.keys))
            self.gram.append(own)

    def history(self, k: int) -> np.ndarray:
        """For every token the place of the k tokens before it, the start being one; -1 where there are fewer."""
        before = np.roll(self.gram[k - 1], 1)
        before[self.begin] = self.origin if k == 1 else -1
        return before

    def parts(self, buckets: int):
        """(bucket, first key of its range, keys in the range, first n-gram, end n-gram) of every bucket."""
        low = floors(buckets)
        cut = np.append(np.searchsorted(self.keys, low[:-1]), len(self.keys)).tolist()
        return zip(range(buckets), low[:-1], np.diff(low).tolist(), cut, cut[1:], strict=False)


def floors(buckets: int) -> np.ndarray:
    """First key of every bucket, and the end of the last."""
    whole, rest = divmod(1 << BITS, buckets)
    b = np.arange(buckets + 1, dtype=U64)
    return b * U64(whole) + (b * U64(rest) + U64(buckets - 1)) // U64(buckets)


def pack_keys(x: np.ndarray, room: int) -> bytes:
    """Different ascending numbers under room, by Elias and Fano: low bits as they are, high ones as gaps in unary."""
    n = len(x)
    if not n:
        return bytes(8)
    low = max((room // n).bit_length() - 1, 0)
    whole, rest = divmod(low, 8)
    tail = x.astype("<u8").view(np.uint8).reshape(n, 8)
    unary = np.zeros(n + (room >> low) + 1, np.uint8)
    unary[(x >> U64(low)).astype(np.int64) + np.arange(n)] = 1
    bits = np.unpackbits(tail[:, whole : whole + 1], axis=1)[:, 8 - rest :]
    return b"".join((np.array([n, low], np.uint32).tobytes(), tail[:, :whole].tobytes(), np.packbits(bits).tobytes(), np.packbits(unary).tobytes()))


def unpack_keys(blob: bytes, room: int) -> tuple[np.ndarray, int]:
    """(the numbers, bytes read)."""
    n, low = np.frombuffer(blob, np.uint32, 2).tolist()
    if not n:
        return np.zeros(0, U64), 8
    whole, rest = divmod(low, 8)
    x = np.zeros((n, 8), np.uint8)
    x[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, 8).reshape(n, whole)
    at = 8 + n * whole
    if rest:
        size = -(-n * rest // 8)
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n * rest).reshape(n, rest)
        x[:, whole] = np.packbits(bits, axis=1)[:, 0] >> (8 - rest)
        at += size
    size = -(-(n + (room >> low) + 1) // 8)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at))) - np.arange(n)
    return x.view("<u8")[:, 0] | (high.astype(U64) << U64(low)), at + size


def planes(x: np.ndarray, width: int) -> bytes:
    """Counts of width bytes, compressed: first all lowest bytes, then all second ones, and so on."""
    return pa.compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T), "zstd", asbytes=True)


def unplaned(blob: bytes, n: int, width: int) -> np.ndarray:
    raw = pa.decompress(blob, n * width, "zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(f"<u{width}").astype(np.int64)


def pack(b: Block, buckets: int) -> tuple[list[int], list[bytes]]:
    names, blobs = [], []
    for bucket, low, room, x, y in b.parts(buckets):
        names.append(bucket)
        blobs.append(pack_keys(b.keys[x:y] - low, room) + planes(b.count[x:y], 4))
    return names, blobs


def add_up(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket: its training tokens, how many differ, and the corpus counts of every block's n-grams, in the block's order."""
    bucket = table.column("bucket")[0].as_py()
    room = int(np.diff(floors(buckets)[bucket : bucket + 2])[0])
    keys, counts = [], []
    for blob in table.column("blob").to_pylist():
        own, at = unpack_keys(blob, room)
        keys.append(own)
        counts.append(unplaned(blob[at:], len(own), 4))
    base = U64(int(floors(buckets)[bucket]))
    every, place = distinct(np.concatenate(keys) + base)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)  # exact to 2^53
    words = total[((every & U64(3)) == 0) & (every != keyed(ORIGIN, 0)[0])]
    head = np.array([words.sum(), np.count_nonzero(words)], np.int64).tobytes()
    ends = np.cumsum([0, *map(len, keys)])
    back = [head + planes(total[place[i:j]], 8) for i, j in zip(ends, ends[1:], strict=False)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array(back, pa.binary())})


class Automaton:
    """A block's part of the automaton: weights of arcs and of failure arcs by n-gram, 0 counts having neither.

    blobs has every bucket's counts, so N is the sum of their tokens and V that of their different ones.
    """

    def __init__(self, block: Block, blobs: dict[int, bytes], buckets: int, mu: float):
        self.count = np.zeros(len(block.keys), np.int64)
        for bucket, _, _, x, y in block.parts(buckets):
            self.count[x:y] = unplaned(blobs[bucket][16:], y - x, 8)
        heads = np.array([np.frombuffer(b, np.int64, 2) for b in blobs.values()]).sum(axis=0)
        self.tokens, self.words = int(heads[0]), int(heads[1])
        unit = (self.count + 1) / (self.tokens + self.words + 1)
        self.root, self.failure, self.seen = np.log10(unit), np.log10(mu / (self.count + mu)), self.count > 0
        chance = unit  # of an n-gram's last token after the others; an n-gram seen has its shorter ones seen
        for k in range(1, len(block.gram)):
            token = np.full(len(block.keys), -1, np.int32)  # one that ends the n-gram
            some = np.flatnonzero(block.gram[k] >= 0)
            token[block.gram[k][some]] = some
            gram = np.flatnonzero(token >= 0)
            token = token[gram]
            chance[gram] = (self.count[gram] + mu * chance[block.gram[k - 1][token]]) / (self.count[block.history(k)[token]] + mu)
        self.arc = np.log10(chance)

    def walk(self, block: Block) -> np.ndarray:
        """Weight of every step, from the state that the token before it leads to."""
        weight, open_ = np.zeros(len(block.gram[0])), np.arange(len(block.gram[0]))
        for k in range(len(block.gram) - 1, 0, -1):
            state, gram = block.history(k)[open_], block.gram[k][open_]
            real = (state >= 0) & self.seen[state]  # else the state carried is a shorter history
            arc = real & self.seen[gram]
            weight[open_[arc]] += self.arc[gram[arc]]
            failed = real & ~arc
            weight[open_[failed]] += self.failure[state[failed]]
            open_ = open_[~arc]
        weight[open_] += self.root[block.gram[0][open_]]
        return weight


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(math.ceil(size / block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select("doc_id", "text", training(F.col("doc_id")).alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))

    def read(table: pa.Table) -> Block:
        text = table.column("text").combine_chunks()
        return Block(text, table.column("train").to_numpy(zero_copy_only=False), order)

    def send(table: pa.Table) -> pa.Table:
        names, blobs = pack(read(table), n_blocks)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(names), pa.int32()), "bucket": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        return add_up(table, n_blocks)

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        block = read(left)
        blobs = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        automaton = Automaton(block, blobs, n_blocks, mu)
        begin = block.first[:-1]
        known = automaton.count[block.gram[0]] > 0
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": pa.array(~left.column("train").to_numpy(zero_copy_only=False)),
                "n_tokens": pa.array(np.diff(block.first)),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), begin)),
                "train_tokens": pa.array(np.full(len(begin), automaton.tokens)),
                "base_score": pa.array(np.add.reduceat(automaton.root[block.gram[0]], begin)),
                "score": pa.array(np.add.reduceat(automaton.walk(block), begin)),
            }
        )

    sent = dealt.groupBy("block").applyInArrow(send, "block int, bucket int, blob binary")
    counts = sent.groupBy("bucket").applyInArrow(total, "block int, bucket int, counts binary")
    return dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))


def brute(rows: list[tuple[int, str]], order: int = ORDER, mu: float = MU) -> dict[int, tuple]:
    """doc_id -> (held_out, n_tokens, n_known, N, base_score, score) in plain Python. For tests."""
    import re
    import zlib
    from collections import Counter

    cut = {d: ["", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in cut}
    c: Counter = Counter()
    for d, w in cut.items():
        if not held[d]:
            c.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    single = {g[0]: m for g, m in c.items() if len(g) == 1 and g != ("",)}
    n, v = sum(single.values()), len(single)
    out = {}
    for d, w in cut.items():
        base = total = 0.0
        for i in range(1, len(w)):
            p = (single.get(w[i], 0) + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, min(order, i + 1)):
                h = tuple(w[i - k : i])
                p = (c[h + (w[i],)] + mu * p) / (c[h] + mu)
            total += math.log10(p)
        out[d] = (held[d], len(w) - 1, sum(x in single for x in w[1:]), n, base, total)
    return out
