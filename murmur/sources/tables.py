"""Adapters that give the shared test tables the roles of the social/market data model.

| role      | derived from                                                              |
|-----------|---------------------------------------------------------------------------|
| bars      | ``lineitem``: symbol = return flag, one bar per ship day                  |
| posts     | ``orders``: id = order key, title = order priority, created = order date  |
| comments  | ``lineitem`` + ``part``: body = part name, link = ``t3_`` + order key     |
| documents | ``documents`` as long-text items, one of 30 days by document id           |
| sparse    | ``events``: symbol = event type, 30 daily bars                            |

Every adapter is a lazy projection/aggregation over the whole table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DOC_EPOCH = "2024-01-01"
DOC_DAYS = 30


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _epoch_seconds(c: str):
    # timestamp_ntz -> session-zone (UTC) timestamp -> epoch seconds as double
    return F.unix_seconds(F.col(c).cast("timestamp")).cast("double")


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily OHLCV bars per symbol. Unit price = extended price / quantity; close is the
    volume-weighted price; open is the unit price of the first line by (order key, line
    number, part key, supplier key) — line numbers repeat within an order in this data."""
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return (lineitem
            .select(F.col("l_returnflag").alias("symbol"),
                    F.to_date("l_shipdate").alias("date"),
                    unit.alias("unit"), "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber",
                    "l_partkey", "l_suppkey")
            .groupBy("symbol", "date")
            .agg(F.min_by("unit", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("open"),
                 F.max("unit").alias("high"),
                 F.min("unit").alias("low"),
                 # money summed exactly as decimal: the close is the same double on any
                 # partitioning and summation order
                 F.try_divide(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"),
                              F.sum("l_quantity")).alias("close"),
                 F.sum("l_quantity").alias("volume")))


def bars_from_events(events: DataFrame) -> DataFrame:
    """Sparse panel: one bar per (event type, day); few rows per symbol."""
    return (events.select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"),
                          "value", "event_id")
            .groupBy("symbol", "date")
            .agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
                 F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
                 F.count("*").cast("double").alias("volume")))


def posts_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("o_orderpriority").alias("title"),
        _epoch_seconds("o_orderdate").alias("created_utc"),
        F.floor("o_totalprice").cast("long").alias("score"),
    )


def comments_from_lineitem(lineitem: DataFrame, part: DataFrame | None) -> DataFrame:
    """Comments keyed ``<order>-<line>-<part>-<supplier>-<ship day>``; body is the part name (a shuffle join on part key,
    left so a line without a part keeps a NULL body). ``part=None`` skips the join for
    consumers that never read the body (counts, relations)."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    if part is None:
        joined = li.withColumn("p_name", F.lit(None).cast("string"))
    else:
        pt = part.select("p_partkey", "p_name")
        joined = li.join(pt, li.l_partkey == pt.p_partkey, "left")
    return (joined
            # (order, line, part, supplier, ship day) is the line's identity; the line
            # number alone repeats within an order in this data
            .select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                F.to_date("l_shipdate").cast("string")).alias("id"),
                    F.col("l_suppkey").cast("string").alias("author"),
                    F.col("p_name").alias("body"),
                    _epoch_seconds("l_shipdate").alias("created_utc"),
                    F.col("l_quantity").cast("long").alias("score"),
                    F.concat(F.lit("t3_"), F.col("l_orderkey").cast("string")).alias("link_id")))


def documents_as_items(documents: DataFrame) -> DataFrame:
    """Long texts as social items: ``(item_id, date, kind, ord, text, score)``.
    Day = one of 30 consecutive days by document id; kind 1 (post); ord = doc id."""
    return documents.select(
        F.col("doc_id").alias("item_id"),
        F.date_add(F.lit(DOC_EPOCH).cast("date"), (F.col("doc_id") % DOC_DAYS).cast("int")).alias("date"),
        F.lit(1).alias("kind"),
        F.col("doc_id").alias("ord"),
        F.col("text"),
        F.col("n_chars").alias("score"),
    )


def label_scores(labels: DataFrame) -> DataFrame:
    """A third, human-label 'scorer' per document: quality - toxic in {-1, 0, 1}."""
    return labels.select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("label_score"))


def threads_from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as threads: turn 0 opens a post, later turns are replies that carry
    only a permalink ``/r/chat/comments/<conv_id>/turn_<n>/`` (no link id column)."""
    posts = conversations.where(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("id"), F.col("role").alias("author"),
        F.col("text").alias("title"), F.lit(None).cast("double").alias("created_utc"),
        F.length("text").cast("long").alias("score"))
    replies = conversations.where(F.col("turn") > 0).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"),
        F.col("text").alias("body"), F.lit(None).cast("double").alias("created_utc"),
        F.length("text").cast("long").alias("score"),
        F.concat(F.lit("/r/chat/comments/"), F.col("conv_id").cast("string"), F.lit("/turn_"),
                 F.col("turn").cast("string"), F.lit("/")).alias("permalink"))
    return posts, replies
