"""S1-S4 file sources, K1 sinks, R1 incremental stream, X3 scorer fallbacks."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmur.operators import scoring
from murmur.sources import files
from murmur.streaming import incremental


def _tmp():
    return tempfile.mkdtemp(prefix="murmur-test-")


def test_social_csv_multiline_and_null_spellings(spark):
    d = _tmp()
    pd.DataFrame({"id": ["p1", "p2"], "author": ["a", "NA"], "title": ["line one\nline two", "x"],
                  "created_utc": [1_700_000_000.0, 1_700_086_400.0], "score": [3, 4]}).to_csv(f"{d}/posts.csv", index=False)
    pd.DataFrame({"id": ["c1"], "author": ["b"], "body": ['say "hi",\nthere'], "created_utc": [1_700_000_100.0],
                  "score": [1], "permalink": ["/r/x/comments/p1/t/"]}).to_csv(f"{d}/comments.csv", index=False)
    posts, comments = files.read_social(spark, f"{d}/posts.csv", f"{d}/comments.csv")
    rows = {r["id"]: r for r in posts.collect()}
    assert rows["p1"]["title"] == "line one\nline two" and rows["p2"]["author"] is None
    c = comments.collect()[0]
    assert c["body"] == 'say "hi",\nthere' and "link_id" not in comments.columns
    assert posts.count() == 2


def test_bar_fallback_ladder_and_guard(spark):
    d = _tmp()
    pd.DataFrame({"Date": [None, None], "Close": ["1", "2"]}).to_csv(f"{d}/bars.csv", index=False)
    pd.DataFrame({"Date": ["2024-01-02", "2024-01-03"], "Close": [10, 11], "High": [11, 12], "Low": [9, 10],
                  "Open": [10, 11], "Volume": [100, 0], "Extra": [1, 2]}).to_csv(f"{d}/merged.csv", index=False)
    bars = files.read_bars(spark, f"{d}/bars.csv", f"{d}/merged.csv", symbol="TSLA")
    assert bars.count() == 2 and set(bars.columns) == {"symbol", "date", "close", "high", "low", "open", "volume"}
    assert files.has_rows(bars, 2) and not files.has_rows(bars, 3)


def test_csv_sink_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_table(df, f"{d}/out", fmt="csv")
    back = spark.read.option("header", True).csv(f"{d}/out")
    assert sorted(r["v"] for r in back.collect()) == ["a", "b"]


def test_incremental_stream_is_exactly_once(spark):
    src, sink, ckpt = _tmp(), _tmp() + "/sink", _tmp() + "/ckpt"
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    out = incremental.incremental_irony(spark, src, sink, ckpt, ["doc_id"], path_glob="*.parquet")
    assert out.count() == 2
    spark.createDataFrame([(3, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    out = incremental.incremental_irony(spark, src, sink, ckpt, ["doc_id"], path_glob="*.parquet")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]
    assert out.where(F.col("sarcasm_label") != "UNKNOWN").count() == 0


def test_scorer_failures_fail_the_task(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k long, text string")

    def broken_factory():
        raise RuntimeError("no model")

    def flaky_factory():
        def run(texts):
            if "bad" in texts:
                raise ValueError("batch failed")
            return [{"POSITIVE": 0.9, "negative": 0.05, "neutral": 0.05} for _ in texts]
        return run

    assert {r["s"] for r in scoring.probability_scores(df, ["k"], "text", None, "s").collect()} == {0.0}
    for factory, said in ((broken_factory, "no model"), (flaky_factory, "batch failed")):
        with pytest.raises(Exception, match=said):
            scoring.probability_scores(df, ["k"], "text", factory, "s", batch_size=1).collect()
    got = scoring.probability_scores(df.where("k = 1"), ["k"], "text", flaky_factory, "s").collect()
    assert abs(got[0]["s"] - 0.85) < 1e-12
    irony = scoring.irony_scores(df, ["k"], "text", lambda: (lambda t: [{"label": "irony", "score": 0.7}] * len(t)))
    assert {(r["sarcasm_label"], r["sarcasm_score"]) for r in irony.collect()} == {("irony", 0.7)}


def test_rescore_items_foreach_batch(spark):
    from murmur.plans import pipelines
    src, sink, ckpt = _tmp(), _tmp() + "/sink", _tmp() + "/ckpt"
    spark.createDataFrame([(1, "x" * 4000), (2, "b")], "doc_id long, text string").coalesce(1) \
        .write.mode("append").parquet(src)

    def model():
        return lambda texts: [{"positive": min(len(t), 1800) / 1800, "negative": 0.0} for t in texts]

    out = pipelines.rescore_items(spark, src, sink, ckpt, ["doc_id"], model=model)
    got = {r["doc_id"]: r for r in out.collect()}
    # 4,000 chars -> chunks of 1800, 1800, 400 -> mean of (1, 1, 400/1800)
    assert abs(got[1]["finbert"] - (2 + 400 / 1800) / 3) < 1e-12
    assert got[2]["sarcasm_label"] == "UNKNOWN"
    spark.createDataFrame([(3, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    out = pipelines.rescore_items(spark, src, sink, ckpt, ["doc_id"], model=model)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]


def test_rescore_items_needs_a_model_and_keeps_rows_and_columns(spark):
    from murmur.streaming.incremental import rescore_items
    src = _tmp()
    spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "c", "z")], "doc_id long, text string, more string") \
        .coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(ValueError):
        rescore_items(spark, src, _tmp() + "/sink", _tmp() + "/ckpt", ["doc_id"])
    out = rescore_items(spark, src, _tmp() + "/sink", _tmp() + "/ckpt", ["doc_id"],
                        irony=lambda: (lambda t: [{"label": x, "score": 0.5} for x in t]))
    assert sorted((r["more"], r["sarcasm_label"]) for r in out.collect()) == [("x", "a"), ("y", "b"), ("z", "c")]


def test_csv_is_read_by_header_name(spark):
    d = _tmp()
    with open(f"{d}/posts.csv", "w") as fh:
        fh.write('title,extra,id,score,author,created_utc\n"he\nllo",q,p1,5.0,ann,1700000000\n')
    with open(f"{d}/comments.csv", "w") as fh:
        fh.write("subreddit,id,author,body,created_utc,score,link_id\nstocks,c1,bob,hi,1700000001,3,t3_p1\n")
    posts, comments = files.read_social(spark, f"{d}/posts.csv", f"{d}/comments.csv")
    assert posts.drop(*files.ORDINAL).first().asDict() == {"id": "p1", "author": "ann", "title": "he\nllo", "created_utc": 1.7e9, "score": 5}
    c = comments.first()
    assert (c["author"], c["link_id"], c["score"]) == ("bob", "t3_p1", 3)
    with open(f"{d}/bars.csv", "w") as fh:
        fh.write("Volume,Date,Close,High,Low,Open\n10,2024-01-02,1,2,0.5,1.5\nx,2024-01-03,1,2,0.5,1.5\n")
    bars = files.read_bars(spark, f"{d}/bars.csv").collect()
    assert [(str(r["date"]), r["volume"], r["symbol"]) for r in bars] == [("2024-01-02", 10.0, None)]


def test_observed_counters(spark):
    from murmur.operators import relations
    df = spark.createDataFrame([(True,), (False,), (False,)], "has_parent_post boolean")
    observed, obs = relations.with_counters(df, "orphans", "has_parent_post")
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "not_has_parent_post": 2}


def test_read_lexicon_and_load_text(spark):
    from murmur.operators import lexicon as lex
    d = _tmp()
    with open(f"{d}/lex.tsv", "w") as fh:
        fh.write("Good\t1.9\t0.5\t[2]\nbad\t-2.5\t0.7\t[1]\nbroken\tx\t0\t[]\n")
    got = {r["term"]: r["valence"] for r in lex.read_lexicon(spark, f"{d}/lex.tsv").collect()}
    assert got == {"good": 1.9, "bad": -2.5}
    df = spark.createDataFrame([(1_700_000_000.0, "hi"), (None, "x"), (1_700_086_400.0, None)],
                               "created_utc double, body string")
    rows = files.load_text(df, "body").collect()
    assert [(str(r["date"]), r["text"]) for r in rows] == [("2023-11-14", "hi")]


def test_incremental_irony_reads_a_table_of_one_file_and_of_many(spark):
    from murmur.plans.catalog import QUERIES
    rows = [(1, "eee"), (2, "ooo"), (3, None), (3, "eo"), (None, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = QUERIES["item_letter_labels"]
    one, many = _tmp(), _tmp()
    docs.toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{one}/documents.parquet", index=False)
    docs.repartition(3).write.parquet(f"{many}/documents.parquet")
    for sf in (one, many):
        got = QUERIES["incremental_irony"](spark, sf).collect()
        assert sorted(map(str, got)) == sorted(map(str, want(spark, sf).collect())) and len(got) == len(rows)
