"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule is a row of RULES: (name, metric, comparison, bound, fewest words). A
document fails a rule if the metric compares to the bound as named and the
document has that many words. Metrics are length, symbol, stop-word and line
ratios. Nothing is shuffled and no user function runs.

Edge cases: null text counts as empty, an empty text has no words and fails the
base rule, every input row gives one output row (repeated rows too), further
input columns are left alone, and clashing names are overwritten by the
operator's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Common function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on be at by this from or are an which not have "
    "de la le et les des en un une du que dans pour par sur au qui pas elle est ce il ne se plus "
    "der die und den von zu das mit sich dem ein eine nicht ist auf für im auch als es an wird "
    "el los las del y a se no por con su para una lo como más o pero sus al"
).split()

#: name, metric, comparison, bound, fewest words
RULES = (
    ("long", "n_words", ">", 1_000_000.0, 0),
    ("short_words", "mean_word_length", "<", 2.0, 0),
    ("long_words", "mean_word_length", ">", 15.0, 0),
    ("symbols", "symbol_ratio", ">", 0.30, 0),
    ("shouting", "exclamation_ratio", ">", 0.50, 0),
    ("few_stop_words", "stop_word_ratio", "<", 0.02, 50),
    ("duplicate_lines", "duplicate_line_ratio", ">", 0.30, 0),
    ("bullets", "bullet_line_ratio", ">", 0.90, 0),
    ("ellipses", "ellipsis_line_ratio", ">", 0.30, 0),
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the array.

    Windows are told apart by a 64-bit hash within one text. Equal hashes are
    found by sorting (hash, position), so time is n log n for any text.
    """

    def covered(starts: Column) -> Column:
        gained = F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1))))
        return F.aggregate(gained, F.lit(0), lambda a, x: a + x)

    def equal_neighbours(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda e, i: (F.coalesce(F.get(pairs, i - 1)["h"] == e["h"], F.lit(False))) | (F.coalesce(F.get(pairs, i + 1)["h"] == e["h"], F.lit(False))),
        )
        return F.array_sort(F.transform(twice, lambda e: e["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, equal_neighbours), covered))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])), count)

    return F.when(F.size(words) > WINDOW, let(words, of)).otherwise(F.lit(0))


def failed(rule: tuple[str, str, str, float, int], value: Column, n_words: Column) -> Column:
    name, _, comparison, bound, fewest = rule
    broken = value < bound if comparison == "<" else value > bound
    return F.when(F.coalesce(broken, F.lit(False)) & (n_words >= fewest), F.lit(name))


def counted(part: Column) -> dict[str, Column]:
    """Counts of one text from a struct of text, words and lines."""
    whole, words, lines = part["text"], part["words"], part["lines"]
    stop = [f for w in STOP_WORDS for f in (w, w.capitalize())]
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.size(F.regexp_extract_all(whole, F.lit(SYMBOLS), F.lit(0))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "n_lines": F.size(lines),
        "n_stop": F.size(F.filter(words, lambda w: w.isin(*stop))),
        "n_shout": F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit(""))),
        "n_bullet": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]\s"))),
        "n_ellipsis": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }


def judged(c: Column, rules) -> Column:
    """The operator's columns as a struct, from a struct of counts."""
    ratio = lambda a, b: c[a] / F.nullif(c[b], F.lit(0))
    metrics = {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "exclamation_ratio": ratio("n_shout", "n_words"),
        "stop_word_ratio": ratio("n_stop", "n_words"),
        "duplicate_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis", "n_lines"),
    }
    base = (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    broken = F.array_compact(F.array(*[failed(r, metrics[r[1]] if r[1] in metrics else c[r[1]], c["n_words"]) for r in rules]))
    return F.struct(*[c[n].alias(n) for n in own], *[m.alias(n) for n, m in metrics.items()], base.alias("base_failed"), broken.alias("failed_rules"), (~base & (F.size(broken) == 0)).alias("kept"))


def verdict(text: Column, rules=RULES) -> Column:
    """One expression for all columns: the text is split once, wherever the optimizer puts it (a filter on kept too)."""
    whole = F.coalesce(text, F.lit(""))
    part = F.struct(
        whole.alias("text"),
        F.array_remove(F.split(whole, SPACE, -1), "").alias("words"),
        F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"),
    )
    return let(let(part, lambda p: F.struct(*[v.alias(n) for n, v in counted(p).items()])), lambda c: judged(c, rules))


def quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the metrics, failed_rules, base_failed and kept."""
    found = docs.withColumn("_verdict", verdict(F.col(text), rules))
    fields = found.schema["_verdict"].dataType.names
    return found.withColumns({n: F.col(f"_verdict.{n}") for n in fields}).drop("_verdict")


def op2(docs: DataFrame) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = quality(docs.select("doc_id", "text"))
    return found.select("doc_id", *columns, F.array_join("failed_rules", ",").alias("failed_rules"))


# word_chars is what is left of a text without the blank characters between words.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
s AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p+4], chr(10))) AS c FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p + o) AS n FROM s, (SELECT unnest(range(0, 5)) AS o) WHERE c >= 2 GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def oracle() -> str:
    """DuckDB SQL for op2: the base and then the rules of RULES."""
    stop = ",".join("'" + f + "'" for w in STOP_WORDS for f in (w, w.capitalize()))
    tests = " ".join(
        f", CASE WHEN coalesce({m} {c} {b}, false) AND n_words >= {k} THEN '{n}' END" for n, m, c, b, k in RULES
    )
    return rf"""
WITH base AS ({ORACLE}),
extra AS (
  SELECT doc_id, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop,
    length(t) - length(replace(t, '!', '')) AS n_shout,
    len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]\s'))) AS n_bullet,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})\s*$'))) AS n_ellipsis
  FROM (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents)),
m AS (
  SELECT base.*, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbol_ratio,
    n_shout / nullif(n_words, 0) AS exclamation_ratio, n_stop / nullif(n_words, 0) AS stop_word_ratio,
    n_dup_lines / nullif(n_lines, 0) AS duplicate_line_ratio, n_bullet / nullif(n_lines, 0) AS bullet_line_ratio,
    n_ellipsis / nullif(n_lines, 0) AS ellipsis_line_ratio
  FROM base JOIN extra USING (doc_id)),
f AS (SELECT *, concat_ws(','{tests}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""
