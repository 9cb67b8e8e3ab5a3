"""The forms for hot keys and long series: associative filter scan, relation of skewed links, sketched median."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import affine, ordering, relations, timeseries as ts


def filtered(zs, q, r, p0=1.0):
    """The recursion itself; None before the first observation."""
    x = p = None
    out = []
    for z in zs:
        if x is None:
            if z is not None:
                x, p = z, p0 * r / (p0 + r)
        elif z is None:
            p += q
        else:
            x, p = x + (p + q) / (p + q + r) * (z - x), r * (p + q) / (p + q + r)
        out.append(x)
    return out


def series(spark, lists):
    start = date(2020, 1, 1)
    rows = [(k, start + timedelta(days=i), z, "kept") for k, zs in lists.items() for i, z in enumerate(zs)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, date date, close double, more string")


def check(spark, lists, q, r, **kw):
    got = affine.kalman_scan(series(spark, lists), transition_noise=q, observation_noise=r, **kw)
    assert got.columns == ["symbol", "date", "close", "more", "kalman_close"]
    rows = {}
    for x in got.orderBy("date").collect():
        rows.setdefault(x["symbol"], []).append(x["kalman_close"])
    assert set(rows) == set(lists)
    for k, zs in lists.items():
        want = filtered(zs, q, r)
        assert [v is None for v in rows[k]] == [v is None for v in want]
        assert np.allclose([v for v in rows[k] if v is not None], [v for v in want if v is not None], rtol=1e-11, atol=1e-11)


@pytest.mark.parametrize("q,r", [(1.0, 1.0), (0.01, 5.0), (1e-9, 1e6), (50.0, 0.001), (0.0, 3.0)])
def test_the_scan_equals_the_recursion(spark, q, r):
    rnd = random.Random(int(q * 100 + r))
    lists = {k: [None if rnd.random() < gaps else rnd.uniform(-5, 500) for _ in range(n)]
             for k, n, gaps in (("hot", 700, 0.3), ("full", 60, 0.0), ("one", 1, 0.0), ("sparse", 90, 0.9), (None, 40, 0.2))}
    check(spark, lists | {"late": [None] * 9 + [4.0, None, 6.0], "never": [None] * 5}, q, r, num_partitions=9)


def test_runs_go_on_over_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, {"a": [float(i * i % 17) for i in range(100)], "b": [2.0] * 30, "c": [None, 1.0]}, 0.5, 0.7, num_partitions=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_scan_of_an_empty_table_and_of_nan(spark):
    assert affine.kalman_scan(spark.createDataFrame([], "symbol string, date date, close double, more string")).count() == 0
    check(spark, {"a": [1.0, None, 3.0]}, 1.0, 1.0)
    rows = spark.createDataFrame([("a", date(2020, 1, 1 + i), z) for i, z in enumerate([1.0, float("nan"), 3.0])], "symbol string, date date, close double")
    got = [x["kalman_close"] for x in affine.kalman_scan(rows).orderBy("date").collect()]
    assert np.allclose(got, filtered([1.0, None, 3.0], 1.0, 1.0))


def skewed(spark, n=12_000):
    posts = spark.range(400).selectExpr("cast(id as string) id", "'a' author", "concat('t', id) title", "id score")
    link = F.when(F.col("id") % 3 == 0, "t3_7").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("t3_"), (F.col("id") * 37 % 900).cast("string")))
    comments = spark.range(0, n, 1, 16).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("b").alias("author"), link.alias("link_id"))
    return posts, comments


def test_a_third_of_the_rows_on_one_post_is_no_single_task(spark):
    posts, comments = skewed(spark)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def tasks(rel):  # a join whose posts nobody reads would be planned away
            return sorted(r["n"] for r in rel.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("title")).collect())

        sizes = tasks(relations.relation_of_skewed(posts, comments))
        worst = max(tasks(relations.relation(posts, comments)))
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sum(sizes) == 12_000 and worst > 4000
    shuffled = [s for s in sizes if s > 300]  # the tasks of the shuffled part
    assert max(sizes) <= 2 * shuffled[len(shuffled) // 2] and max(sizes) < worst / 3


def test_the_relation_of_skewed_links_equals_the_plain_one(spark):
    posts, comments = skewed(spark, 3000)
    for p, c in ((posts, comments), (posts, comments.where("link_id IS NULL")), (posts.where("false"), comments), (posts, comments.where("false"))):
        a, b = relations.relation_of_skewed(p, c), relations.relation(p, c)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_hot_links_are_those_with_the_share(spark):
    _, comments = skewed(spark)
    links = relations.ensure_link_id(comments)
    assert relations.hot_links(links, share=4) == ["7"] and relations.hot_links(links.where("false")) == []


@pytest.mark.parametrize("shape", ["uniform", "ties", "sorted"])
def test_the_sketched_median_is_within_its_rank_error(spark, shape):
    n = 40_000
    value = {"uniform": F.rand(3), "ties": F.floor(F.rand(3) * 9).cast("double"), "sorted": F.col("id").cast("double")}[shape]
    rows = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.lit("s")).alias("symbol"), F.when(F.col("id") % 10 != 9, value).alias("v")).persist()
    med = {r["symbol"]: r for r in ts.sketched_median(rows, "v", ["symbol"]).collect()}
    assert set(med) == {None, "s"}
    for key, got in med.items():
        values = np.sort([r["v"] for r in rows.where(F.col("symbol").eqNullSafe(F.lit(key))).collect() if r["v"] is not None])
        assert got["_med_rows"] == len(values)
        lo, hi = np.searchsorted(values, got["_med"], "left") / len(values), np.searchsorted(values, got["_med"], "right") / len(values)
        assert lo <= 0.5 + ts.RANK_ERROR and hi >= 0.5 - ts.RANK_ERROR
    rows.unpersist()


def test_features_with_the_sketch_differ_in_the_regime_only(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(s, date(2020, 1, 1) + timedelta(days=i), 100 * rnd.uniform(0.9, 1.1), 10.0 + i % 7) for s in ("a", "b", None) for i in range(120)],
                                 "symbol string, date date, close double, volume double")
    for blocks in (None, 50):
        exact, sketch = (ts.features(rows, sentiment=None, drop_incomplete=False, block_rows=blocks, median=m) for m in ("exact", "sketch"))
        assert exact.columns == sketch.columns
        a, b = ({(r["symbol"], r["date"]): r.asDict() for r in x.collect()} for x in (exact, sketch))
        other = sum(a[k].pop("market_regime") != b[k].pop("market_regime") for k in a)
        assert a == b and len(a) == 360 and other <= 360 * 2 * ts.RANK_ERROR + 3


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_comments_are_not_sorted_for_their_posts(spark):
    posts = spark.createDataFrame([("1", "a"), ("2", None), (None, "x"), ("1", "b")], "id string, title string")
    comments = spark.createDataFrame([("c1", "t3_1"), ("c2", "1"), ("c3", "t3_9"), ("c4", None), ("c5", "t3_t3_1"), ("c6", "t3_")], "id string, link_id string")
    rel, lost = relations.relation(posts, comments), relations.orphans(posts, comments)
    assert "ShuffledHashJoin" in _plan(rel) and "ShuffledHashJoin" in _plan(lost)
    assert sorted((r["id_comment"], r["link_id"], r["title"]) for r in rel.collect()) == [
        ("c1", "1", "a"), ("c2", "1", "a"), ("c3", "9", None), ("c4", None, None), ("c5", "t3_1", None), ("c6", "", None)]
    assert sorted(r["id"] for r in lost.collect()) == ["c3", "c4", "c5", "c6"]


def test_texts_of_a_day_are_made_distinct_without_a_sort(spark):
    from murmur.operators import textchunks
    rows = [(date(2024, 1, 1), 0, k, t) for k, t in (("a", "one"), ("a", "one"), ("b", None), (None, "two"), ("c", "x" * 9))]
    chunks = textchunks.daily_chunks(spark.createDataFrame(rows, "date date, kind int, ord string, text string"), 4)
    assert "SortAggregate" not in _plan(chunks)
    assert "".join(r["text"] for r in chunks.orderBy("chunk").collect()) == "two one one  xxxxxxxxx"


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_texts_are_shuffled_once_to_be_chunked(spark, reuse):
    """The day's offsets and the texts come from one shuffle: no join of the texts with their offsets by key, nothing stored."""
    from murmur.operators import textchunks
    rows = [(None if i % 9 == 0 else date(2024, 1, 1 + i % 2), i % 2, None if i % 5 == 0 else f"k{i % 60}", None if i % 11 == 0 else "añ\ud55c" * (i % 40)) for i in range(400)]
    rows += [(date(2024, 2, 1), 0, "x", None), *[(date(2024, 2, 2), 0, None, "same")] * 30]
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.createDataFrame(rows, "date date, kind int, ord string, text string").repartition(5)
        chunks = textchunks.daily_chunks(df, 50, num_partitions=6)
        got = {}
        for r in chunks.collect():
            got.setdefault(r["date"], {})[r["chunk"]] = r["text"]
        if reuse == "true":
            assert "SortMergeJoin" not in _plan(chunks) and "ShuffledHashJoin" not in _plan(chunks) and _plan(chunks).count("RDD") == 2
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    assert set(got) == {r[0] for r in rows} and got[date(2024, 2, 1)] == {0: ""}
    for day, parts in got.items():
        mine = [r for r in rows if r[0] == day]
        text = "".join(parts[k] for k in range(len(parts)))
        assert len(text) == sum(len(r[3] or "") for r in mine) + len(mine) - 1
        assert all(len(parts[k]) == 50 for k in range(len(parts) - 1))
        keys = {(k, o) for _, k, o, _ in mine}
        at = 0
        for key in sorted(keys, key=lambda x: (x[0], x[1] is not None, x[1] or "")):  # equal keys come in an order of their own
            want = sorted(r[3] or "" for r in mine if r[1:3] == key)
            size = sum(map(len, want)) + len(want)
            assert sorted((text + " ")[at:at + size - 1].split(" ")) == want
            at += size


def test_settled_tables_leave_no_shuffle_files(spark, monkeypatch):
    """A daily table is stored, its shuffle files go before the next step begins, and the setting is as it was."""
    import glob
    import os

    from murmur.plans import catalog
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    at = str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {os.path.basename(f) for f in glob.glob(f"{at}/*/shuffle_*.data")}
    held = files()
    days = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("date"))
    assert sorted(map(tuple, catalog.settled(days.groupBy("date").count()).collect())) == [(k, 143 if k < 6 else 142) for k in range(1, 7)]
    assert spark.conf.get(key, "false") == before and not files() - held


def test_prefix_sums_leave_the_other_columns_alone(spark):
    big = (1 << 62) + 1
    rows = [(g, i, big if i % 2 else None, i) for g in (None, "a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, other long, w long").repartition(7)
    got = ordering.range_prefix(df, ["i"], ["g"], "w", num_partitions=5).collect()
    assert {(r["g"], r["i"], r["other"], r["_before"], r["_group_total"]) for r in got} == {
        (g, i, o, i * (i - 1) // 2, 1225) for g, i, o, _ in rows} and len(got) == len(rows)
