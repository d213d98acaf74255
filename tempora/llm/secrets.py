"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Every text is scanned for three base kinds and for opaque mixed-case strings.
Each candidate's hash is aggregated over distinct repositories (documents) and
owners (sources). A value that many owners carry is an example copied around;
one that stays with few owners looks live. Base matches are always reported
and classed; an opaque string becomes a span only if it looks live.

Offsets come from splitting a text at its matches: a match starts where the
pieces and matches before it end. Only texts that match are split.

Edge cases: null text is empty; null owner or doc_id is an owner or repository
of its own; every input row gives one row (repeated rows too, each a row of
the same repository); very long texts are matched whole; spans that overlap are
all listed, by start and kind; an empty table gives an empty one; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_lookup, staged

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: (kind, pattern, a pattern that every passing match holds, group, fewest characters of that group)
KINDS = (
    ("assign", ASSIGN, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 8),
    ("access", ACCESS, r"AKIA[A-Z0-9]{12}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 0, 32),
)
#: The method's kind: a run of base-64 characters that has a digit and both cases.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{20}", 0, 20)
#: A value is an example if at least so many owners, and so many repositories, carry it.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 3


def spans_of(text: Column, order: int, kind: tuple) -> Column:
    """array<struct<start, kind, end, value hash>> of one kind's matches that pass; empty for most texts."""
    name, pattern, needed, group, fewest = kind
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)

    def place(parts: Column) -> Column:
        lengths = F.transform(parts["found"], lambda m, i: F.struct(F.length(F.get(parts["pieces"], i)).alias("gap"), F.length(m).alias("own"), F.get(parts["values"], i).alias("value")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + x["own"]).alias("end"), x["value"].alias("value"))
            return F.struct((begin + x["own"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(lengths, start, step)["out"]

    parts = F.struct(found.alias("found"), values.alias("values"), pieces.alias("pieces"))
    placed = F.element_at(F.transform(F.array(parts), place), 1)
    passing = F.filter(placed, lambda s: F.length(s["value"]) >= fewest)
    if name == "opaque":
        passing = F.filter(passing, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    hashed = F.transform(passing, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h1"), F.hash(s["value"]).alias("h2")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,h1:bigint,h2:int>>")
    return F.when(text.rlike(needed), hashed).otherwise(empty)


def candidates(docs: DataFrame, text: str, repository: str, owner: str) -> DataFrame:
    """row, repository, owner and every candidate span of each document; one pass over the texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = (*KINDS, OPAQUE)
    found = docs.select(F.col(repository).alias("repository"), F.col(owner).alias("owner"), *[spans_of(whole, i, k).alias(k[0]) for i, k in enumerate(kinds)])
    return found.withColumn("row", F.monotonically_increasing_id())


def ownership(spans: DataFrame) -> DataFrame:
    """h1, h2, uses, repositories, owners, example for every candidate hash.

    Distinct counts are reached by nested groupings, each combined before its
    shuffle, so a value found everywhere reaches one task only as partial counts.
    """
    by_repository = spans.groupBy("h1", "h2", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = by_repository.groupBy("h1", "h2", "owner").agg(F.sum("uses").alias("uses"), F.count("*").alias("repositories"))
    total = by_owner.groupBy("h1", "h2").agg(F.sum("uses").alias("uses"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    return total.withColumn("example", (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))


def secret_scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: repository, owner, spans (start, kind, end, example) and the base kinds' arrays."""
    rows = staged(candidates(docs, text, repository, owner), "secrets")
    names = [k[0] for k in (*KINDS, OPAQUE)]
    some = rows.where(sum((F.size(n) for n in names), F.lit(0)) > 0)
    exploded = some.select("row", "repository", "owner", F.explode(F.concat(*names)).alias("s")).select("row", "repository", "owner", "s.*")
    table = staged(ownership(exploded), "owners").select("h1", "h2", "uses", "example")
    judged = skew_lookup(exploded, table, ["h1", "h2"], "uses")
    kept = judged.where((F.col("kind") < len(KINDS)) | ~F.col("example"))
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "example"))).alias("spans"))
    return rows.join(lists, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>")))


def line(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, OPAQUE)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6(docs: DataFrame) -> DataFrame:
    found = secret_scan(docs.select("doc_id", "text", "source"))
    base = F.array_sort(F.filter("spans", lambda s: s["kind"] < len(KINDS)))
    return found.select(
        F.col("repository").alias("doc_id"),
        *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"),
    )
