"""Smaller helpers: parity text, link extraction, union order, broadcast bound, spread."""

from pyspark.sql import functions as F

from murmur.functions import text
from murmur.operators import clean, joins
from murmur.operators.partitioning import _bytes, estimated_bytes, spread


def test_parity_stringify_and_permalink(spark):
    df = spark.createDataFrame([(None, "/r/a/comments/xyz/title/"), ("t", "/r/a/")], "t string, p string")
    rows = df.select(text.stringify("t", parity=True).alias("a"), text.stringify("t").alias("b"),
                     text.link_id_from_permalink(F.col("p")).alias("l")).collect()
    assert [(r["a"], r["b"], r["l"]) for r in rows] == [("nan", None, "xyz"), ("t", "t", None)]


def test_union_items_keeps_kind_and_order(spark):
    c = spark.createDataFrame([("c1", "body", 1)], "id string, body string, score long").withColumn("date", F.lit(None).cast("date"))
    p = spark.createDataFrame([("p1", None, 2)], "id string, title string, score long").withColumn("date", F.lit(None).cast("date"))
    rows = {r["item_id"]: r for r in clean.union_items(c, p, parity=True).collect()}
    assert rows["0:c1"]["kind"] == 0 and rows["1:p1"]["text"] == "nan"


def test_bounded_broadcast_respects_the_bound(spark):
    small = spark.range(5)
    big = spark.range(50)
    assert "ResolvedHint" in small.hint("broadcast")._jdf.queryExecution().analyzed().toString()
    hinted = joins.bounded_broadcast(small, max_rows=10)._jdf.queryExecution().analyzed().toString()
    plain = joins.bounded_broadcast(big, max_rows=10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_spread_only_small_inputs(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df, 4).rdd.getNumPartitions() == 4
    assert _bytes("128m") == 128 << 20 and _bytes("134217728b") == 134217728
    assert estimated_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) > 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")  # every input now counts as "large"
    try:
        scan = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
        assert spread(scan, 4) is scan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_replace_column_and_semi_prune(spark):
    target = spark.createDataFrame([(1, 0.3), (2, 0.4)], "date int, finbert_sentiment double")
    fresh = spark.createDataFrame([(1, 0.9), (3, 0.1)], "date int, finbert_sentiment double")
    got = {r["date"]: r["finbert_sentiment"] for r in joins.replace_column(target, fresh, ["date"], "finbert_sentiment").collect()}
    assert got == {1: 0.9, 2: 0.0}
    assert joins.semi_prune(fresh, target, ["date"]).count() == 1
