"""Hand-made edge frames (FIXTURES section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from murmur.functions import labels, text
from murmur.operators import clean, ordering, relations, stats, textchunks, timeseries as ts
from murmur.sources import files

POSTS = "id string, author string, title string, created_utc double, score long"
COMMENTS = "id string, author string, body string, created_utc double, score long, link_id string"


def test_duplicate_post_id_fans_out_only_in_parity(spark):
    posts = spark.createDataFrame([("a", "u", "t1", 1.0, 1), ("a", "u", "t2", 1.0, 1)], POSTS)
    comments = spark.createDataFrame([("c1", "v", "b", 2.0, 1, "a")], COMMENTS)
    par = relations.relation(posts, comments, parity=True)
    assert par.count() == 2
    rel_counts = relations.comment_counts(comments, parity_relation=par).collect()
    assert rel_counts[0]["comment_count"] == 2
    assert relations.relation(posts, comments).count() == 1
    assert relations.comment_counts(comments).collect()[0]["comment_count"] == 1


def test_exact_duplicate_and_null_key_dedup(spark):
    c = spark.createDataFrame([("c", "u", "b", 1.0, 1, "a"), ("c", "u", "b", 1.0, 1, "a")], COMMENTS)
    assert clean.dedup_comments(c).count() == 1
    n = spark.createDataFrame([("c", None, "b", 1.0, 1, "a"), ("c", None, "b", 1.0, 2, "a")], COMMENTS)
    assert clean.dedup_comments(n).count() == 1
    first = clean.dedup_comments(n.withColumn("o", F.col("score")), order_by="o").collect()
    assert first[0]["score"] == 1


def test_permalink_without_comments_segment_is_orphan(spark):
    posts = spark.createDataFrame([("abc", "u", "t", 1.0, 1)], POSTS)
    c = spark.createDataFrame([("c1", "v", "b", 1.0, 1, "/r/x/")], "id string, author string, body string, "
                              "created_utc double, score long, permalink string")
    rel = relations.relation(posts, c).collect()[0]
    assert rel["link_id"] is None and rel["has_parent_post"] is False
    par = relations.relation(posts, c, parity=True).collect()[0]
    assert par["link_id"] == "nan" and par["has_parent_post"] is False
    assert relations.orphans(posts, c).count() == 1


def test_t3_prefix(spark):
    c = spark.createDataFrame([("1", "t3_abc"), ("2", "abc"), ("3", "xt3_abc")], "id string, link_id string")
    got = {r["id"]: r["link_id"] for r in relations.ensure_link_id(c).collect()}
    assert got == {"1": "abc", "2": "abc", "3": "xt3_abc"}


def test_parent_with_null_title(spark):
    posts = spark.createDataFrame([("a", "u", None, 1.0, 1)], POSTS)
    comments = spark.createDataFrame([("c1", "v", "b", 2.0, 1, "a")], COMMENTS)
    assert relations.relation(posts, comments, parity=True).collect()[0]["has_parent_post"] is False
    assert relations.relation(posts, comments).collect()[0]["has_parent_post"] is True


def test_post_without_comments(spark):
    posts = spark.createDataFrame([("a", "u", "t", 1.0, 50)], POSTS)
    comments = spark.createDataFrame([("c1", "v", "b", 2.0, 1, "zzz")], COMMENTS)
    p = relations.posts_with_counts(posts, relations.comment_counts(comments))
    row = relations.enrich_posts(p).collect()[0]
    assert row["comment_count"] == 0 and row["engagement"] == pytest.approx(1.5)


def test_topic_priority_and_relevance(spark):
    df = spark.createDataFrame([("Elon on earnings",), ("stockholm",), (None,), ("TESLA tesla Model 3",)], "t string")
    rows = df.select(text.topic("t").alias("topic"), text.relevance("t").alias("rel")).collect()
    assert [r["topic"] for r in rows] == ["Earnings", "Stock Market", "General Tesla", "General Tesla"]
    assert [r["rel"] for r in rows] == [1, 0, 0, 2]


def test_bad_bars_are_dropped(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "10", "11", "9", "10", "100"), ("2024-01-03", "abc", "11", "9", "10", "100"),
         ("", "10", "11", "9", "10", "100"), ("Ticker", "TSLA", "TSLA", "TSLA", "TSLA", "TSLA")],
        "Date string, Close string, High string, Low string, Open string, Volume string")
    out = files.coerce_bars(raw, "TSLA").collect()
    assert len(out) == 1 and out[0]["close"] == 10.0


def _bars(spark, n, price=10.0, volume=100.0):
    rows = [("S", i, price, price, price, price, volume) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date int, open double, high double, low double, "
                                       "close double, volume double")


def test_zero_volume_illiquidity_is_null(spark):
    b = _bars(spark, 3, volume=0.0)
    rows = ts.features(b, sentiment=None, drop_incomplete=False).orderBy("date").collect()
    assert rows[1]["return"] == 0.0 and rows[1]["illiquidity"] is None


@pytest.mark.parametrize("n,expected", [(29, 0), (30, 1)])
def test_constant_price_window_guards(spark, n, expected):
    out = ts.features(_bars(spark, n), sentiment=None)
    assert out.count() == expected
    if expected:
        assert out.collect()[0]["market_regime"] == "Low Volatility"


def test_missing_volatility_is_low_regime(spark):
    rows = ts.features(_bars(spark, 3), sentiment=None, drop_incomplete=False).collect()
    assert {r["market_regime"] for r in rows} == {"Low Volatility"}


def test_thresholds_and_nulls(spark):
    vals = [0.05, -0.05, 0.0500001, -0.0500001, 0.25, -0.25, 0.75, -0.75, 0.2499, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select(labels.three_class("x").alias("a"), labels.five_class("x").alias("b")).collect()
    assert [r["a"] for r in rows] == ["neutral", "neutral", "positive", "negative", "positive", "negative",
                                      "positive", "negative", "positive", "neutral"]
    assert [r["b"] for r in rows] == ["Neutral", "Neutral", "Neutral", "Neutral", "Positive", "Negative",
                                      "Extremely Positive", "Extremely Negative", "Neutral", "Neutral"]


def test_kappa_single_class_is_null(spark):
    df = spark.createDataFrame([("neutral", "neutral")] * 5, "a string, b string")
    assert stats.cohen_kappa(df, [("a", "b")]).collect()[0]["kappa"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "x double")
    h = {r["bin"]: r["count"] for r in stats.histogram(df, "x", 4).collect()}
    assert h == {0: 1, 1: 0, 2: 1, 3: 1}
    same = spark.createDataFrame([(2.0,)] * 3, "x double")
    h2 = {r["bin"]: r["count"] for r in stats.histogram(same, "x", 25).collect()}
    assert sum(h2.values()) == 3 and h2[12] == 3 and len(h2) == 25


@pytest.mark.parametrize("length,expected", [(0, 1), (1800, 1), (1801, 2), (9000, 5)])
def test_chunk_counts(spark, length, expected):
    df = spark.createDataFrame([("x" * length,)], "t string")
    assert df.select(F.size(text.chunk_array("t", 1800)).alias("n")).collect()[0]["n"] == expected
    items = spark.createDataFrame([(1, 0, 1, "x" * length)], "date int, kind int, ord int, text string")
    assert textchunks.daily_chunks(items).count() == expected


@pytest.mark.parametrize("n,expected", [(10, 2), (11, 3), (193, 39)])
def test_split_sizes(spark, n, expected):
    df = spark.createDataFrame([("S", i) for i in range(n)], "symbol string, date int")
    assert ts.chronological_split(df).where("is_test").count() == expected


def test_sample_small_table_and_partitioning(spark):
    df = spark.createDataFrame([(i,) for i in range(40)], "k long")
    a = sorted(r["k"] for r in ordering.seeded_sample(df, "k", 100).collect())
    assert len(a) == 40
    big = spark.createDataFrame([(i,) for i in range(1000)], "k long")
    s1 = sorted(r["k"] for r in ordering.seeded_sample(big.repartition(1), "k", 100).collect())
    s7 = sorted(r["k"] for r in ordering.seeded_sample(big.repartition(7), "k", 100).collect())
    assert s1 == s7 and len(s1) == 100


def test_r2_constant_target_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 1.5)], "actual double, prediction double")
    r = stats.regression_metrics(df).collect()[0]
    assert r["r2"] is None and r["mae"] == pytest.approx(0.5) and r["rmse"] == pytest.approx(0.5)
    assert not math.isnan(r["mae"])


def test_correlation_with_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 0.0, None), (3.0, 0.0, 7.0), (4.0, 0.0, 1.0)],
                               "a double, z double, b double")
    got = {(r["row"], r["col"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "z", "b"]).collect()}
    assert got[("a", "z")] is None and got[("z", "z")] is None
    assert got[("a", "a")] == pytest.approx(1.0)
    import numpy as np
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 3, 4], [2, 7, 1])[0, 1])


def test_repeated_and_null_keys_keep_their_texts(spark):
    rows = [(1, 0, "a", "bad day"), (1, 0, "a", "good day"), (1, 0, None, "lost"), (1, 0, None, "lost")]
    items = spark.createDataFrame(rows, "date int, kind int, ord string, text string")
    got = textchunks.daily_chunks(items).collect()
    assert len(got) == 1 and sorted(got[0]["text"].split()) == sorted("bad day good day lost lost".split())
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    from murmur.operators import lexicon as lex
    scored = lex.score_items(items, lexicon, "ord").collect()
    assert sorted(round(r["vader"], 3) for r in scored) == [-0.459, 0.0, 0.0, 0.459]
    day = lex.daily_scores(items.withColumn("score", F.lit(1)), lexicon).collect()
    assert day[0]["item_count"] == 4 and abs(day[0]["avg_sentiment"]) < 1e-12


def test_long_texts_are_cut_in_linear_time(spark):
    items = spark.createDataFrame([(1, 0, i, "é" * 5000) for i in range(3)], "date int, kind int, ord int, text string")
    got = {r["chunk"]: r["text"] for r in textchunks.daily_chunks(items, 1800).collect()}
    joined = " ".join(["é" * 5000] * 3)
    assert got == {k: joined[k * 1800:(k + 1) * 1800] for k in range(-(-len(joined) // 1800))}


def test_small_blocks_are_refused(spark):
    df = spark.createDataFrame([("S", i) for i in range(5)], "symbol string, date int")
    with pytest.raises(ValueError):
        ts.blocked_apply(df, ["symbol"], "date", lambda d, k: d, 10)
