import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import jaccard, pieces, quality

R = random.Random(8)
STOPS = "the of and to in is that for it with".split()


def sentence(n=12):
    return " ".join(R.choice(STOPS) if R.random() < 0.3 else f"Word{R.randint(0, 900)}" for _ in range(n)) + "."


def texts():
    line = "this license line stands in many documents, and goes"
    item = " ".join(f"item{i}" for i in range(20))
    plain = [" ".join(sentence() for _ in range(8)) for _ in range(12)]
    near = [plain[0] + " more", plain[0], plain[1].replace("the", "a", 1)]
    lines = [f"{sentence()} {sentence()}\n{line}\n{sentence()}" for _ in range(4)]
    dirty = [f"{sentence()} {item} {sentence()}", f"{item}"]
    junk = ["# $ % & | #", "tiny", "la la la la la la la la la la la la la la la", "", None, " \n "]
    return item, plain + near + lines + dirty + junk


def expected(item, rows):
    """run()'s doc_ids and texts before encoding, in plain Python (the rules by their DuckDB SQL)."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    good = {d for d, kept in con.sql(f"SELECT doc_id, kept FROM ({quality.oracle()})").fetchall() if kept}
    rows = [(d, t) for d, t in rows if d in good]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for d, t in rows:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    rows = [(d, "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d)) for d, t in rows]
    group = jaccard.brute(rows)
    rows = [(d, t) for d, t in rows if group[d][1] == d]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    own = words(item)
    windows = {tuple(own[i : i + 13]) for i in range(len(own) - 12)}
    out = {}
    for d, t in rows:
        w = words(t)
        hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[d] = t
    return out


def test_run_against_plain_python(spark, tmp_path):
    item, all_texts = texts()
    rows = list(enumerate(all_texts, 1))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int, kept string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(item, rows)
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert 12 < len(want) < len(rows) - 6
    vocabulary = pieces.Vocabulary(pieces.MODEL)
    assert all(pieces.decode(vocabulary, r.pieces) == want[r.doc_id] and r.round_trip and len(r.pieces) == r.n_pieces for r in got)


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(sentence() for _ in range(6))
    odd = spark.createDataFrame([(None, text, "a"), (3, text, "b"), (3, text, "b"), (4, None, "c"), (5, "", "d")], "doc_id long, text string, _score string")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            n = out.count()
            assert n <= docs.count() and (n > 0 or docs.count() == 0)


def test_quality_stage_splits_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = corpus_pipeline.quality_rules(spark, docs.withColumn("text", F.concat("text", F.lit(" c"))), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2  # words and lines
