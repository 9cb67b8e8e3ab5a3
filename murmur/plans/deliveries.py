"""Queries over files that Spark writes from the shared tables and reads back as raw deliveries.

Each run writes into a new folder of the shared scratch. What is delivered is stated beside each query, so
that DuckDB can say from the tables alone which rows must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from murmur.operators import clean, lexicon as lex, scoring
from murmur.plans import pipelines
from murmur.plans.artifacts import ArtifactGraph
from murmur.plans.catalog import ORACLE, register
from murmur.session import shared_scratch_path
from murmur.sources import files, tables as tb, versions
from murmur.streaming import incremental


def _order_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose titles hold a newline, quotes and a comma, and the order key behind them."""
    posts = tb.posts_from_orders(tb.load(spark, sf, "orders"))
    title = F.concat("title", F.lit('\nsaid "buy", order '), "id")
    return posts.withColumn("title", title).withColumn("key", F.col("id").cast("long"))


POST_COLUMNS = ["score", "title", "id", "created_utc", "author"]  # not the order of the schema


def _deliver(df: DataFrame, path: str) -> None:
    files.write_table(df.select(*POST_COLUMNS), path, fmt="csv")


_POSTS_SQL = """
posts AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author,
    o_orderpriority || chr(10) || 'said "buy", order ' || o_orderkey AS title, CAST(o_orderdate AS DATE) AS date,
    CAST(floor(o_totalprice) AS BIGINT) AS score, o_orderkey AS key FROM orders)"""


@register("first_delivered_posts", f"""
WITH {_POSTS_SQL}
SELECT id, author, title, date, CASE WHEN key % 5 = 0 THEN score - 1 ELSE score END AS score FROM posts""")
def q_first_delivered_posts(spark: SparkSession, sf: str) -> DataFrame:
    """U2 in file order. The first delivery lacks every fifth post and holds every third twice in one file, its second row
    with a lower score; the second delivery has all posts with a score lower by 1, the third every other one, lower by 5."""
    posts = _order_posts(spark, sf)
    root = shared_scratch_path(spark, "deliveries")
    lower = lambda by: F.col("score") - by
    first = posts.where("key % 5 <> 0").withColumn("turn", F.explode(F.when(F.col("key") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    first = first.withColumn("score", lower(F.col("turn") * 1000)).repartition("id").sortWithinPartitions("id", "turn")
    _deliver(first, f"{root}/day-1")
    _deliver(posts.withColumn("score", lower(1)), f"{root}/day-2")
    _deliver(posts.where("key % 2 = 0").withColumn("score", lower(5)), f"{root}/day-3")
    rows = files.ingest(spark, f"{root}/day-*", files.POSTS_SCHEMA).rows
    return clean.dedup_posts(clean.add_date(rows)).select("id", "author", "title", "date", "score")


def _with_rejects(spark: SparkSession, sf: str) -> str:
    """Every 7th score and every 11th time are unreadable, every 13th title is missing; every 17th post comes again as a line
    with a field too many."""
    posts, root = _order_posts(spark, sf), shared_scratch_path(spark, "rejects")
    every = lambda n, c, text: F.when(F.col("key") % n == 0, F.lit(text)).otherwise(F.col(c).cast("string"))
    _deliver(posts.select("id", "author", "key", every(13, "title", None).alias("title"), every(11, "created_utc", "soon").alias("created_utc"),
                          every(7, "score", "n.a. 7").alias("score")), f"{root}/values")
    header = ",".join(POST_COLUMNS)
    lines = posts.where("key % 17 = 0").select(F.concat_ws(",", F.lit("1"), F.lit("t"), "id", F.lit("2"), "author", F.lit("more")).alias(header))
    # one column whose name is the whole header: the lines are written as they stand
    lines.write.option("header", True).option("sep", "\x01").csv(f"{root}/malformed")
    return f"{root}/*"


@register("csv_quarantine", f"""
WITH {_POSTS_SQL},
seen AS (
  SELECT 'rows' AS reason, count(*) + count_if(key % 17 = 0) AS rows FROM posts
  UNION ALL SELECT 'malformed', count_if(key % 17 = 0) FROM posts
  UNION ALL SELECT 'bad_score', count_if(key % 7 = 0) FROM posts
  UNION ALL SELECT 'bad_created_utc', count_if(key % 11 = 0) FROM posts
  UNION ALL SELECT 'missing_title', count_if(key % 13 = 0) FROM posts
  UNION ALL SELECT 'kept', count_if(key % 13 <> 0) FROM posts)
SELECT reason, rows, CASE WHEN reason IN ('rows', 'kept') THEN NULL ELSE rows END AS quarantined FROM seen""")
def q_csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What landing counted, and what the quarantine holds for each reason."""
    got = files.ingest(spark, _with_rejects(spark, sf), files.POSTS_SCHEMA, required=("title",))
    counted = {k: v for k, v in got.counts.items() if not k.startswith("missing_") or k == "missing_title"}
    held = got.rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("quarantined"))
    seen = spark.createDataFrame([*counted.items(), ("kept", got.rows.count())], "reason string, rows long")
    return seen.join(held, "reason", "left")


@register("csv_posts", f"""
WITH {_POSTS_SQL}
SELECT id, author, title, CASE WHEN key % 11 = 0 THEN NULL ELSE date END AS date, CASE WHEN key % 7 = 0 THEN NULL ELSE score END AS score
FROM posts WHERE key % 13 <> 0""")
def q_csv_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts through CSV with newlines, quotes and a header in another order; unreadable values are NULL."""
    rows = files.ingest(spark, _with_rejects(spark, sf), files.POSTS_SCHEMA, required=("title",)).rows
    return clean.add_date(rows).select("id", "author", "title", "date", "score")


@register("csv_texts", f"""
WITH {_POSTS_SQL}
SELECT date, count(*) AS texts, CAST(sum(length(title)) AS BIGINT) AS chars FROM posts WHERE key % 13 <> 0 AND key % 11 <> 0 GROUP BY date""")
def q_csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The dated texts of a delivery, rows without time or text dropped."""
    rows = files.ingest(spark, _with_rejects(spark, sf), files.POSTS_SCHEMA).rows
    return files.load_text(rows, "title").groupBy("date").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"))


def _bars_csv(spark: SparkSession, sf: str) -> str:
    """Daily bars under the original's column names in another order, with a second header row for each symbol; on every 10th
    of a month the date is unreadable, on every 20th the volume is empty."""
    bars = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    day = F.dayofmonth("date")
    text: dict[str, Column] = {c: F.col(c).cast("string") for c in ("close", "high", "low", "open")}
    out = bars.select(F.when(day == 20, None).otherwise(F.col("volume").cast("string")).alias("Volume"), *(c.alias(n.capitalize()) for n, c in text.items()),
                      F.col("symbol").alias("Symbol"), F.when(day == 10, "tomorrow").otherwise(F.col("date").cast("string")).alias("Date"))
    extra = bars.select("symbol").distinct().select(*(F.lit("TICKER" if c != "Symbol" else None).alias(c) if c != "Symbol" else F.col("symbol").alias(c) for c in out.columns))
    path = shared_scratch_path(spark, "bars")
    files.write_table(out.unionByName(extra), path, fmt="csv")
    return path


@register("csv_bars", """
WITH lines AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS unit, * FROM lineitem)
SELECT symbol, date, arg_min(unit, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open, max(unit) AS high, min(unit) AS low,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS close, sum(l_quantity) AS volume
FROM lines WHERE day(date) NOT IN (10, 20) GROUP BY symbol, date""")
def q_csv_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written as CSV, guarded, and read back through the fallback ladder (the first file has no dates)."""
    path, empty = _bars_csv(spark, sf), shared_scratch_path(spark, "no-dates")
    files.write_table(spark.read.option("header", True).csv(path).withColumn("Date", F.lit(None).cast("string")), empty, fmt="csv")
    bars = files.read_bars(spark, empty, fallback_path=path)
    if not files.has_rows(bars):
        raise ValueError(f"{path} holds no bars")
    return bars.select("symbol", "date", "open", "high", "low", "close", "volume")


@register("resumed_flow", f"""
WITH counts AS (
  SELECT 'posts' AS artifact, (SELECT count(*) FROM ({ORACLE['posts_dedup']})) AS rows, false AS written_again
  UNION ALL SELECT 'comments', (SELECT count(*) FROM ({ORACLE['comments_dedup']})), false
  UNION ALL SELECT 'relation', (SELECT count(*) FROM ({ORACLE['post_comment_relation']})), true
  UNION ALL SELECT 'orphans', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), true
  UNION ALL SELECT 'posts_enriched', (SELECT count(*) FROM orders), true
  UNION ALL SELECT 'daily_market', (SELECT count(DISTINCT (l_returnflag, CAST(l_shipdate AS DATE))) FROM lineitem), false
  UNION ALL SELECT 'quality_counters', 3, true)
SELECT * FROM counts""")
def q_resumed_flow(spark: SparkSession, sf: str) -> DataFrame:
    """C1/C3 as an artifact graph: all steps stored once; then the relation's marker is gone, as if the run had been killed while
    it was written, and the second run writes the relation and what needs it, nothing else."""
    li = tb.load(spark, sf, "lineitem")
    inputs = pipelines.Inputs(posts=tb.posts_from_orders(tb.load(spark, sf, "orders")), comments=tb.comments_from_lineitem(li, tb.load(spark, sf, "part")),
                              bars=tb.bars_from_lineitem(li), lexicon=lex.lexicon_frame(spark))
    graph, out = ArtifactGraph(pipelines.preprocess_steps(inputs)), shared_scratch_path(spark, "flow")
    graph.materialise(spark, out, sf)
    files.delete(spark, f"{out}/_markers/relation.json")
    written: dict[str, bool] = {}
    stored = graph.materialise(spark, out, sf, report=written.__setitem__)
    counts = pipelines.quality_counters(stored)
    flags = spark.createDataFrame(list(written.items()), "stage string, written_again boolean")
    return counts.join(flags, "stage").select(F.col("stage").alias("artifact"), "rows", "written_again")


def _deliver_documents(docs: DataFrame, folder: str) -> None:
    docs.repartition(4, "doc_id").write.mode("append").parquet(folder)


def _changed(docs: DataFrame) -> DataFrame:
    """The same documents with another text: every label and score would differ."""
    return docs.withColumn("text", F.concat(F.lit("oooo eee"), F.coalesce("text", F.lit(""))))


@register("stream_deliveries", f"""
SELECT item_id, sarcasm_label, sarcasm_score, 3 AS published FROM ({ORACLE['item_letter_labels']})""")
def q_stream_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Four files at each of three starts of one query. The second start delivers new documents and every fourth old
    one again with a changed text, the third only changed ones; the state store keeps the first text's label."""
    docs = tb.load(spark, sf, "documents").select("doc_id", "text")
    source, sink, state = (shared_scratch_path(spark, n) for n in ("documents", "labels", "state"))
    late = F.col("doc_id") % 3 == 2
    again = _changed(docs.where("doc_id % 4 = 0"))
    published = []
    for delivery in (docs.where(~late), docs.where(late).unionByName(again.where(~late)), again):
        _deliver_documents(delivery, source)
        out = incremental.incremental_irony(spark, source, sink, state, ["doc_id"], factory=scoring.letter_factory,
                                            max_files_per_trigger=3, remember="30 days")
        published = versions.versions(spark, sink)
    return out.withColumnRenamed("doc_id", "item_id").withColumn("published", F.lit(len(published)))


@register("versioned_scores", f"""
WITH labels AS ({ORACLE['item_letter_labels']})
SELECT version, sarcasm_label, count(*) AS items, round(sum(sarcasm_score), 6) AS score
FROM labels, (VALUES (1), (2)) v(version) WHERE version = 2 OR item_id % 2 = 0 GROUP BY version, sarcasm_label""")
def q_versioned_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K3: half the documents are scored and published; then the checkpoint is lost and the whole source is scored by a new
    query in several batches. The first version stays readable as it was, the newest holds nothing of it."""
    docs = tb.load(spark, sf, "documents").select("doc_id", "text")
    source, sink = (shared_scratch_path(spark, n) for n in ("documents", "labels"))
    for half in (0, 1):
        _deliver_documents(docs.where(F.col("doc_id") % 2 == half), source)
        incremental.incremental_irony(spark, source, sink, shared_scratch_path(spark, "state"), ["doc_id"],
                                      factory=scoring.letter_factory, max_files_per_trigger=2)
    both = versions.read(spark, sink, 1).withColumn("version", F.lit(1)).unionByName(versions.read(spark, sink).withColumn("version", F.lit(2)))
    return both.groupBy("version", "sarcasm_label").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("sarcasm_score"), 6).alias("score"))
