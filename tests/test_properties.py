"""Golden values, properties against brute force, and plan shape checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import ml, ordering, stats, textchunks, timeseries as ts

LABELS = ["negative", "neutral", "positive"]


@pytest.mark.parametrize("table,kappa", [
    ([[12, 11, 5], [4, 24, 4], [2, 10, 28]], 0.45255474452554745),
    ([[18, 8, 2], [7, 20, 5], [11, 14, 15]], 0.3055555555555556),
    ([[12, 6, 0], [13, 24, 8], [11, 12, 14]], 0.24789410348977126),
])
def test_golden_kappa(spark, table, kappa):
    rows = [(LABELS[i], LABELS[j]) for i in range(3) for j in range(3) for _ in range(table[i][j])]
    df = spark.createDataFrame(rows, "a string, b string")
    got = stats.cohen_kappa(df, [("a", "b")]).collect()[0]
    assert got["sample_size"] == 100
    assert got["kappa"] == pytest.approx(kappa, abs=1e-15)


def _kalman_reference(z):
    x, p, out = z[0], 0.5, [z[0]]
    for v in z[1:]:
        k = (p + 1) / (p + 2)
        x = x + k * (v - x)
        p = k
        out.append(x)
    return np.array(out)


def test_kalman_fir_equals_recursion(spark):
    rng = np.random.default_rng(7)
    rows = []
    series = {}
    for s, n in (("A", 300), ("B", 45), ("C", 1)):
        z = 100 + np.cumsum(rng.normal(0, 1, n))
        series[s] = z
        rows += [(s, i, float(v)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "symbol string, date int, close double")
    got = ts.kalman_filter(df).orderBy("symbol", "date").collect()
    for s, z in series.items():
        k = np.array([r["kalman_close"] for r in got if r["symbol"] == s])
        assert np.max(np.abs(k - _kalman_reference(z))) < 1e-9


def test_kalman_gains_are_fibonacci_ratios():
    p, gains = 0.5, [0.5]
    for _ in range(5):
        p = (p + 1) / (p + 2)
        gains.append(p)
    assert gains[:4] == pytest.approx([1 / 2, 3 / 5, 8 / 13, 21 / 34])
    assert gains[-1] == pytest.approx(0.6180339887, abs=1e-4)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_range_prefix_matches_brute_force(spark, parts):
    rnd = random.Random(parts)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 4)}", i, rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, w long")
    got = {(r["g"], r["o"]): (r["_before"], r["_group_total"])
           for r in ordering.range_prefix(df, ["o"], ["g"], "w", num_partitions=parts).collect()}
    acc, tot = {}, {}
    for g, o, w in rows:
        tot[g] = tot.get(g, 0) + w
    for g, o, w in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[(g, o)] == (acc.get(g, 0), tot[g])
        acc[g] = acc.get(g, 0) + w


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    rows = [(g, float(rnd.randint(0, 50))) for g in ("a", "b") for _ in range(rnd.randint(5, 200))]
    df = spark.createDataFrame(rows + [("a", None)], "g string, v double")
    got = {(r["g"], r["p"]): r["value"] for r in ordering.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"]).collect()}
    for g in ("a", "b"):
        vals = np.array([v for gg, v in rows if gg == g])
        for p in (0.25, 0.5, 0.9):
            assert got[(g, p)] == pytest.approx(np.percentile(vals, p * 100), abs=1e-12)


@pytest.mark.parametrize("batch", ["10000", "5"])
def test_daily_chunks_match_python_join(spark, batch):
    old_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        _check_daily_chunks(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old_batch)


def _check_daily_chunks(spark):
    rnd = random.Random(11)
    items = []
    for i in range(120):
        day = 0 if rnd.random() < 0.5 else rnd.randint(1, 3)
        txt = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 700))) if rnd.random() > 0.05 else None
        items.append((day, rnd.randint(0, 1), i, txt))
    items.append((9, 1, 999, ""))
    df = spark.createDataFrame(items, "date int, kind int, ord int, text string")
    got = {(r["date"], r["chunk"]): r["text"] for r in textchunks.daily_chunks(df, 300, num_partitions=5).collect()}
    expect = {}
    for day in {d for d, *_ in items}:
        texts = [t or "" for d, k, o, t in sorted(items, key=lambda r: (r[1], r[2])) if d == day]
        joined = " ".join(texts)
        parts = [joined[s:s + 300] for s in range(0, len(joined), 300)] or [""]
        for k, p in enumerate(parts):
            expect[(day, k)] = p
    assert got == expect


def test_ols_matches_numpy_lstsq(spark):
    rng = np.random.default_rng(5)
    n = 60
    x1, x2 = rng.normal(size=n), rng.normal(size=n) * 1e3
    y = (0.3 + 2 * x1 - 0.001 * x2 + rng.normal(scale=0.1, size=n)) * 1e-9
    rows = [("S", i, float(a), float(b), 0.0, float(t)) for i, (a, b, t) in enumerate(zip(x1, x2, y))]
    df = spark.createDataFrame(rows, "symbol string, date int, a double, b double, flat double, illiquidity double")
    pred = ml.model_predictions(df, ["a", "b", "flat"], models=("linear_regression",)).orderBy("date").collect()
    n_test = int(np.ceil(0.2 * n))
    X = np.column_stack([np.ones(n), x1, x2])
    beta = np.linalg.lstsq(X[:-n_test], y[:-n_test] * 1e9, rcond=None)[0]
    expect = X[-n_test:] @ beta / 1e9
    got = np.array([r["linear_regression"] for r in pred])
    assert np.max(np.abs(got - expect)) < 1e-18


def test_results_do_not_depend_on_shuffle_partitions(spark):
    from murmur.plans import catalog
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, catalog.QUERIES["daily_social"](spark, sf).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(map(tuple, catalog.QUERIES["daily_social"](spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_prunes_and_never_single_partition(spark):
    from murmur.plans import catalog
    df = catalog.QUERIES["liquidity_features"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "SinglePartition" not in plan
    assert "Window" in plan
    assert "l_tax" not in plan and "l_discount" not in plan  # column pruning at the scan


def test_lexicon_scoring_stays_in_the_jvm(spark):
    from murmur.plans import catalog
    plan = _plan(catalog.QUERIES["document_sentiment"](spark, "/root/testdata/sf0.001"))
    assert "Python" not in plan and "ArrowEval" not in plan and "MapInPandas" not in plan


def test_blocked_windows_equal_plain_windows(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s, n in (("A", 700), ("B", 260), ("C", 35)):
        z = 100 + np.cumsum(rng.normal(0, 1, n))
        rows += [(s, i, float(v), float(rng.integers(0, 50)), float(rng.normal())) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "symbol string, date int, close double, volume double, avg_sentiment double")

    def rows_of(d):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())

    plain = ts.features(df, drop_incomplete=False)
    blocked = ts.features(df, drop_incomplete=False, block_rows=100)
    assert rows_of(plain) == rows_of(blocked.select(*plain.columns))
    kp = ts.kalman_features(df)
    kb = ts.kalman_features(df, block_rows=64)
    assert rows_of(kp) == rows_of(kb.select(*kp.columns))


def test_histogram_counts_sum_to_rows(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(g, rnd.random() * 10) for g in "xyz" for _ in range(rnd.randint(1, 300))],
                               "g string, v double")
    h = stats.histogram(df, "v", 30, ["g"]).groupBy("g").agg(F.sum("count").alias("n"), F.count("*").alias("bins"))
    n = {r["g"]: r["n"] for r in df.groupBy("g").count().withColumnRenamed("count", "n").collect()}
    for r in h.collect():
        assert r["n"] == n[r["g"]] and r["bins"] == 30


def test_dedup_is_idempotent(spark):
    from murmur.operators import clean
    rnd = random.Random(8)
    rows = [(str(rnd.randint(0, 20)), rnd.choice(["a", None]), "t", 1.0, rnd.randint(0, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "id string, author string, title string, created_utc double, score long")
    once = clean.dedup_posts(df.withColumn("o", F.monotonically_increasing_id()), order_by="o")
    twice = clean.dedup_posts(once, order_by="o")
    key = lambda r: tuple(str(x) for x in r)  # noqa: E731 - NULL-safe ordering
    assert sorted(map(tuple, once.collect()), key=key) == sorted(map(tuple, twice.collect()), key=key)
    assert once.count() == df.dropDuplicates(["id", "author", "title", "created_utc"]).count()


@pytest.mark.parametrize("name", ["liquidity_features", "kalman_smoothing", "market_social_features",
                                  "liquidity_features_blocked", "chronological_split"])
def test_window_queries_never_plan_a_single_partition(spark, name):
    from murmur.plans import catalog
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "SinglePartition" not in _plan(df)


def test_salted_relation_equals_plain(spark):
    from murmur.operators import relations
    rnd = random.Random(12)
    posts = spark.createDataFrame([(str(i), f"u{i}", f"t{i}", 1.0, i) for i in range(20)],
                                  "id string, author string, title string, created_utc double, score long")
    comments = spark.createDataFrame(
        [(f"c{j}", "v", "b", 2.0, 1, "t3_" + ("0" if rnd.random() < 0.5 else str(rnd.randint(0, 25))))
         for j in range(400)], "id string, author string, body string, created_utc double, score long, link_id string")
    key = lambda r: tuple(str(x) for x in r)
    plain = sorted(map(tuple, relations.relation(posts, comments).collect()), key=key)
    salted_df = relations.relation(posts, comments, salt=8)
    assert sorted(map(tuple, salted_df.collect()), key=key) == plain
    assert "_salt" not in salted_df.columns


def test_filters_reach_the_scan(spark):
    from murmur.plans import catalog
    plan = _plan(catalog.QUERIES["conversation_threads"](spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [IsNotNull(turn), EqualTo(turn,0)]" in plan
    assert "PushedFilters: [IsNotNull(turn), GreaterThan(turn,0)]" in plan


def test_range_prefix_across_many_arrow_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(17)
        rows = [(f"g{rnd.randint(0, 3)}", i, rnd.randint(1, 5)) for i in range(400)]
        df = spark.createDataFrame(rows, "g string, o int, w long")
        got = {(r["g"], r["o"]): r["_before"] for r in ordering.range_prefix(df, ["o"], ["g"], "w", num_partitions=3).collect()}
        plain = {(r["g"], r["o"]): r["_before"]
                 for r in ordering.range_prefix(df, ["o"], None, "w", num_partitions=2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    acc = {}
    for g, o, w in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[(g, o)] == acc.get(g, 0)
        acc[g] = acc.get(g, 0) + w
    total = 0
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        assert plain[(g, o)] == total
        total += w
