"""Line dedup: hash normalised lines, count documents per hash, drop repeated lines, reassemble by position.

A line's key is the line without blank characters at both ends, A-Z lowered.
A key of at least min_chars code points that at least min_docs rows hold loses
all its lines, except in the row with the largest doc_id that holds it.

What is shuffled: one small row per (document, key), first combined into counts,
then looked up by key (keys that hold much of the corpus by a bounded
broadcast), and the texts once by document for reassembly.

Edge cases: null or empty text is one empty line. Rows are documents: two rows
with the same doc_id count as two, and rows with the largest doc_id all keep
the line; null doc_id is the smallest. A very long text is split whole, a task
holding one at a time; an empty table gives an empty one. Further columns come
through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_lookup, staged, text_buffer

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = b" \t\n\x0b\x0c\r"
SCHEMA = "k1 long, k2 int, doc_id long, text_hash long, positions array<int>"


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and distinct long key: 96-bit key hash, document, positions."""

    def run(batches):
        fields = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("positions", pa.list_(pa.int32()))])
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            raw, ids, marks = data.tobytes(), batch.column("doc_id"), batch.column("text_hash")
            keys, owner, lists = [], [], []
            for d in range(batch.num_rows):
                seen: dict[bytes, list[int]] = {}
                for i, x in enumerate(raw[offsets[d] : offsets[d + 1]].split(b"\n")):
                    key = x.strip(BLANK)
                    if len(key) < min_chars:
                        continue
                    key = key.lower()
                    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    if key in seen:
                        seen[key].append(i)
                    else:
                        seen[key] = [i]
                keys.extend(map(xxhash.xxh3_128_digest, seen))
                lists.extend(seen.values())
                owner.extend([d] * len(seen))
            if keys:
                h = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64).astype(np.int32)), ids.take(at), marks.take(at), pa.array(lists, pa.list_(pa.int32()))], schema=fields
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SCHEMA)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id long, text, ...) with the column kept_text, and n_lines and n_dropped as _n_lines and _n_dropped."""
    held = staged(occurrences(docs, min_chars), "lines")
    smallest = F.lit(-(2**63))
    rank = F.coalesce(F.col("doc_id"), smallest)
    keys = held.groupBy("k1", "k2").agg(F.count("*").alias("holders"), F.max(rank).alias("keeper")).where(F.col("holders") >= min_docs)
    dropped = skew_lookup(held, staged(keys, "keys"), ["k1", "k2"], "holders").where(rank != F.col("keeper"))
    drops = dropped.groupBy(rank.alias("_rank"), F.col("text_hash").alias("_hash")).agg(F.flatten(F.collect_list("positions")).alias("_drops"))
    rows = docs.withColumns({"_rank": rank, "_hash": F.xxhash64("text")}).join(drops, ["_rank", "_hash"], "left")
    rows = rows.withColumns({"_whole": F.coalesce("text", F.lit("")), "_drops": F.array_distinct("_drops")}).withColumn("_lines", F.split("_whole", "\n", -1))
    n = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drops"))
    joined = F.element_at(F.transform(F.array("_lines"), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), 1)
    out = rows.withColumns(
        {
            "kept_text": F.when(F.col("_drops").isNull(), F.col("_whole")).otherwise(joined),
            "_n_lines": n.cast("long"),
            "_n_dropped": F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long"),
        }
    )
    return out.drop("_rank", "_hash", "_drops", "_whole", "_lines")


def op3(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
