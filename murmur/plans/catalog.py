"""Registered queries over the shared test tables, each with an equivalent DuckDB SQL.

Every query reads whole tables (no id subsets, no row caps) through the adapters in
:mod:`murmur.sources.tables`. Floating outputs are rounded identically on both sides
where the two engines use different algorithms (standard deviations, the Kalman
recursion vs its FIR form). Values both engines compute with the same IEEE operations
(money summed as exact decimals, then divided) are compared unrounded, which avoids the
tie-breaking differences of ``round`` on exact short decimals.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmur import config as _cfg
from murmur.functions.labels import five_class, three_class
from murmur.operators import affine, clean, lexicon as lex, ml, ordering, relations, rollups, scoring, stats, textchunks
from murmur.operators import timeseries as ts
from murmur.session import shared_scratch_path, ship_package
from murmur.sources import files, tables as tb
from murmur.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    """Register a query. Every query pins the session time zone to UTC before building its
    plan: epoch seconds and dates are defined in UTC (the engine's one session requirement)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Rounded outputs are nudged by a relative 1e-12 first: averages of short decimals often
# land exactly on a rounding tie, and the last-bit noise of a different summation order
# would otherwise decide the direction differently in the two engines.
NUDGE = 1.000000000001


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small derived table that a two-pass operator reads twice
    (reliable checkpoint into the cluster's checkpoint folder)."""
    from murmur.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A small derived table (a row per day) computed and stored at once, after which Spark removes the shuffle files it
    took: steps that each shuffle the whole input need the disk of the largest one, not of all together. Rows without a
    date, which no market day joins, are left out below the steps, as they are where one plan holds all."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return pinned(df.where(F.col("date").isNotNull()))  # a frame takes the setting when it is made
    finally:
        conf.set(key, before)


def rnd(c: str, digits: int = 6):
    return F.round(F.col(c) * F.lit(NUDGE), digits).alias(c)


def r_sql(expr: str, digits: int = 6) -> str:
    # "+ 0.0" turns DuckDB's -0.0 into 0.0 (Spark's round never yields -0.0)
    return f"(round(({expr}) * {NUDGE!r}, {digits}) + 0.0)"


# ---------------------------------------------------------------------------------------
# Parameters that make the keyword/topic operators meaningful on the shared tables
# (titles there are order priorities). The original keyword list lives in murmur.config.
# ---------------------------------------------------------------------------------------
DATA_KEYWORDS = ["urgent", "high", "medium", "low", "not", "specified"]
DATA_TOPICS = [("Urgent", ["urgent"]), ("High", ["high"]), ("Unspecified", ["not spec"]),
               ("Low", ["low", "medium"])]
DATA_TOPIC_DEFAULT = "Other"


def _lexicon_sql() -> str:
    rows = ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in lex.DEMO_LEXICON)
    return f"SELECT * FROM (VALUES {rows}) AS lx(term, valence)"


# ---------------------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------------------
BARS_SQL = """
SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date,
       arg_min(l_extendedprice / nullif(l_quantity, 0),
               {'k': l_orderkey, 'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS open,
       max(l_extendedprice / nullif(l_quantity, 0)) AS high,
       min(l_extendedprice / nullif(l_quantity, 0)) AS low,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(sum(l_quantity), 0) AS close,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2"""

EVENT_BARS_SQL = """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
       arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2"""


def features_sql(bars_sql: str, extra_cols: str = "", lag_cols: str = "", where_extra: str = "") -> str:
    return f"""
WITH bars AS ({bars_sql}),
r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret
      FROM bars),
f AS (SELECT *,
        CASE WHEN count(ret) OVER w7 = 7 THEN stddev_samp(ret) OVER w7 END AS volatility_7d,
        abs(ret) / nullif(volume, 0) AS illiquidity,
        CASE WHEN count(volume) OVER w30 = 30 THEN volume / nullif(avg(volume) OVER w30, 0) END
          AS turnover_ratio{lag_cols}
      FROM r
      WINDOW w AS (PARTITION BY symbol ORDER BY date),
             w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
             w30 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN volatility_7d > median(volatility_7d) OVER (PARTITION BY symbol)
                     THEN 'High Volatility' ELSE 'Low Volatility' END AS market_regime
      FROM f)
SELECT symbol, date, close, volume, ret AS return, (round((volatility_7d) * {NUDGE!r}, 9) + 0.0) AS volatility_7d,
       illiquidity, turnover_ratio,
       market_regime{extra_cols}
FROM g
WHERE ret IS NOT NULL AND volatility_7d IS NOT NULL AND illiquidity IS NOT NULL
  AND turnover_ratio IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL
  {where_extra}"""


def _features_out(df: DataFrame, extra: list | None = None) -> DataFrame:
    return df.select("symbol", "date", "close", "volume", "return",
                     rnd("volatility_7d", 9), "illiquidity", "turnover_ratio",
                     "market_regime", *(extra or []))


# ---------------------------------------------------------------------------------------
# Market side
# ---------------------------------------------------------------------------------------
@register("daily_bars", f"""
SELECT symbol, date, open, high, low, close, volume FROM ({BARS_SQL})""")
def q_daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """S2 role: daily OHLCV bars per symbol (partial aggregation before the shuffle)."""
    b = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    return b.select("symbol", "date", "open", "high", "low", "close", "volume")


@register("liquidity_features", features_sql(BARS_SQL))
def q_liquidity_features(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship (W1-W6, W9, A7): daily illiquidity, volatility regime and turnover per symbol."""
    b = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    return _features_out(ts.features(b, sentiment=None))


@register("sparse_features", features_sql(EVENT_BARS_SQL))
def q_sparse_features(spark: SparkSession, sf: str) -> DataFrame:
    """W9 on a short panel (30 days per symbol): the 30-row window is full only on the last day."""
    b = tb.bars_from_events(tb.load(spark, sf, "events"))
    return _features_out(ts.features(b, sentiment=None))


@register("kalman_smoothing", f"""
WITH RECURSIVE bars AS ({BARS_SQL}),
b AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM bars),
k AS (SELECT symbol, t, close AS x, CAST(0.5 AS DOUBLE) AS p FROM b WHERE t = 0
      UNION ALL
      SELECT b.symbol, b.t, k.x + (k.p + 1) / (k.p + 2) * (b.close - k.x), (k.p + 1) / (k.p + 2)
      FROM k JOIN b ON b.symbol = k.symbol AND b.t = k.t + 1),
j AS (SELECT b.symbol, b.date, b.close, k.x AS kalman_close FROM b JOIN k USING (symbol, t)),
r AS (SELECT *, kalman_close / nullif(lag(kalman_close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1
                 AS kalman_return FROM j),
v AS (SELECT *, CASE WHEN count(kalman_return) OVER w7 = 7 THEN stddev_samp(kalman_return) OVER w7 END
                 AS kalman_volatility
      FROM r WINDOW w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT symbol, date, (round((close) * {NUDGE!r}, 6) + 0.0) AS close, (round((kalman_close) * {NUDGE!r}, 6) + 0.0) AS kalman_close,
       (round((kalman_return) * {NUDGE!r}, 9) + 0.0) AS kalman_return, (round((kalman_volatility) * {NUDGE!r}, 9) + 0.0) AS kalman_volatility
FROM v""")
def q_kalman_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """W7+W8: Kalman-smoothed close as a 41-row FIR window, its return and 7-row volatility."""
    b = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    k = ts.kalman_features(b)
    return k.select("symbol", "date", rnd("close"), rnd("kalman_close"), rnd("kalman_return", 9),
                    rnd("kalman_volatility", 9))


# ---------------------------------------------------------------------------------------
# Social side: posts = orders, comments = lineitem lines (body = part name)
# ---------------------------------------------------------------------------------------
POSTS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author,
       o_orderpriority AS title, CAST(epoch(o_orderdate) AS DOUBLE) AS created_utc,
       CAST(floor(o_totalprice) AS BIGINT) AS score, CAST(o_orderdate AS DATE) AS date
FROM orders"""

COMMENTS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS id, CAST(l_suppkey AS VARCHAR) AS author,
       p_name AS body, CAST(epoch(l_shipdate) AS DOUBLE) AS created_utc,
       CAST(l_quantity AS BIGINT) AS score,
       regexp_replace(concat('t3_', CAST(l_orderkey AS VARCHAR)), '^t3_', '') AS link_id,
       CAST(l_shipdate AS DATE) AS date
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""


def _posts(spark, sf):
    return clean.add_date(tb.posts_from_orders(tb.load(spark, sf, "orders")), keep_timestamp=False)


def _comments(spark, sf, with_body: bool = True):
    part = tb.load(spark, sf, "part") if with_body else None
    c = tb.comments_from_lineitem(tb.load(spark, sf, "lineitem"), part)
    return clean.add_date(c, keep_timestamp=False)


def _relevance_sql(col: str, keywords) -> str:
    low = f"lower(coalesce({col}, ''))"
    return "CAST(" + " + ".join(f"CASE WHEN instr({low}, '{k}') > 0 THEN 1 ELSE 0 END" for k in keywords) + " AS INTEGER)"


def _topic_sql(col: str, rules, default) -> str:
    low = f"lower(coalesce({col}, ''))"
    whens = " ".join("WHEN " + " OR ".join(f"instr({low}, '{n}') > 0" for n in needles) + f" THEN '{name}'"
                     for name, needles in rules)
    return f"CASE {whens} ELSE '{default}' END"


@register("posts_dedup", f"""
WITH p AS (SELECT id, author, title, created_utc, score, 0 AS delivery FROM ({POSTS_SQL})
           UNION ALL
           SELECT id, author, title, created_utc, score + 1, 1 FROM ({POSTS_SQL}))
SELECT id, author, title, created_utc, arg_min(score, delivery) AS score
FROM p GROUP BY id, author, title, created_utc""")
def q_posts_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Posts delivered twice (the re-delivery carries a changed score); keep the first
    delivery per (id, author, title, created_utc) — map-side collapsed, no window."""
    p = tb.posts_from_orders(tb.load(spark, sf, "orders"))
    twice = p.withColumn("delivery", F.lit(0)).unionByName(
        p.withColumn("score", F.col("score") + 1).withColumn("delivery", F.lit(1)))
    return clean.dedup_posts(twice, order_by="delivery").drop("delivery")


@register("post_comment_relation", f"""
WITH c AS ({COMMENTS_SQL}), p AS ({POSTS_SQL})
SELECT c.id AS id_comment, c.link_id AS link_id, p.id AS id_post, p.title AS title,
       c.author AS author_comment, p.author AS author_post, p.id IS NOT NULL AS has_parent_post
FROM c LEFT JOIN p ON c.link_id = p.id""")
def q_post_comment_relation(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + P11 + F3/F4: every comment with its parent post and the parent flag."""
    rel = relations.relation(_posts(spark, sf), _comments(spark, sf, with_body=False))
    return rel.select("id_comment", "link_id", "id_post", "title", "author_comment", "author_post",
                      "has_parent_post")


@register("orphan_comments", f"""
WITH c AS ({COMMENTS_SQL}), p AS ({POSTS_SQL})
SELECT count(*) AS comments, count(*) FILTER (WHERE p.id IS NULL) AS orphans,
       count(DISTINCT c.link_id) FILTER (WHERE p.id IS NULL) AS missing_posts
FROM c LEFT JOIN p ON c.link_id = p.id""")
def q_orphan_comments(spark: SparkSession, sf: str) -> DataFrame:
    """J9 + P12 + A12: comment count, orphan count and the number of missing parents."""
    rel = relations.relation(_posts(spark, sf), _comments(spark, sf, with_body=False))
    return rel.agg(F.count(F.lit(1)).alias("comments"),
                   F.count_if(~F.col("has_parent_post")).alias("orphans"),
                   F.count_distinct(F.when(~F.col("has_parent_post"), F.col("link_id"))).alias("missing_posts"))


@register("post_engagement", f"""
WITH p AS ({POSTS_SQL}),
cc AS (SELECT link_id, count(*) AS comment_count FROM ({COMMENTS_SQL}) GROUP BY link_id)
SELECT p.id, p.date, CAST(coalesce(cc.comment_count, 0) AS BIGINT) AS comment_count,
       {_relevance_sql('p.title', DATA_KEYWORDS)} AS relevance,
       {_topic_sql('p.title', DATA_TOPICS, DATA_TOPIC_DEFAULT)} AS topic,
       (round((1 + ln(1 + coalesce(cc.comment_count, 0)) + p.score / 100) * {NUDGE!r}, 6) + 0.0) AS engagement
FROM p LEFT JOIN cc ON p.id = cc.link_id""")
def q_post_engagement(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + J2 + P9 + F7-F9: comments per post (0 when none), relevance, topic, engagement."""
    posts = _posts(spark, sf)
    counts = relations.comment_counts(_comments(spark, sf, with_body=False))
    enriched = relations.enrich_posts(relations.posts_with_counts(posts, counts),
                                      DATA_KEYWORDS, DATA_TOPICS, DATA_TOPIC_DEFAULT)
    return enriched.select("id", "date", "comment_count", "relevance", "topic", rnd("engagement"))


DAILY_POSTS_SQL = f"""
WITH p AS ({POSTS_SQL}),
cc AS (SELECT link_id, count(*) AS comment_count FROM ({COMMENTS_SQL}) GROUP BY link_id),
e AS (SELECT p.date, coalesce(cc.comment_count, 0) AS comment_count,
             {_relevance_sql('p.title', DATA_KEYWORDS)} AS relevance,
             1 + ln(1 + coalesce(cc.comment_count, 0)) + p.score / 100 AS engagement
      FROM p LEFT JOIN cc ON p.id = cc.link_id)
SELECT date, avg(engagement) AS engagement, avg(relevance) AS relevance,
       avg(comment_count) AS mean_post_comments
FROM e GROUP BY date"""


@register("daily_posts", f"""
SELECT date, (round((engagement) * {NUDGE!r}, 6) + 0.0) AS engagement, relevance, mean_post_comments
FROM ({DAILY_POSTS_SQL})""")
def q_daily_posts(spark: SparkSession, sf: str) -> DataFrame:
    """A4: per-day mean engagement, relevance and comments per post."""
    return _daily_posts(spark, sf).select("date", rnd("engagement"), "relevance", "mean_post_comments")


def _daily_posts(spark, sf):
    posts = _posts(spark, sf)
    counts = relations.comment_counts(_comments(spark, sf, with_body=False))
    enriched = relations.enrich_posts(relations.posts_with_counts(posts, counts),
                                      DATA_KEYWORDS, DATA_TOPICS, DATA_TOPIC_DEFAULT)
    return rollups.daily_posts(enriched)


# ---------------------------------------------------------------------------------------
# Lexicon scoring (T1-T3) over whole texts
# ---------------------------------------------------------------------------------------
def lexicon_scores_sql(items_sql: str, keep: str = "") -> str:
    from murmur import config as cfg
    negs = ", ".join(f"'{n}'" for n in cfg.NEGATORS)
    return f"""
WITH items AS ({items_sql}),
lx AS ({_lexicon_sql()}),
tk AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{lex.TOKEN_PATTERN}') AS t FROM items),
ex AS (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS p FROM tk),
fl AS (SELECT item_id, t[p] AS term,
              list_has_any(t[greatest(p - {cfg.NEGATION_LOOKBACK}, 1):p - 1], [{negs}]) AS negated FROM ex),
hits AS (SELECT fl.item_id, lx.valence, fl.negated FROM fl JOIN lx ON fl.term = lx.term),
agg AS (SELECT item_id,
               sum(valence * CASE WHEN negated THEN {cfg.NEGATION_SCALAR} ELSE 1 END) AS s,
               avg(valence / {cfg.POLARITY_SCALE} * CASE WHEN negated THEN {cfg.POLARITY_NEGATION} ELSE 1 END) AS pol
        FROM hits GROUP BY item_id)
SELECT items.item_id{keep},
       coalesce(s / sqrt(s * s + {cfg.COMPOUND_ALPHA}), CAST(0 AS DOUBLE)) AS vader,
       coalesce(pol, CAST(0 AS DOUBLE)) AS textblob
FROM items LEFT JOIN agg ON items.item_id = agg.item_id"""


DOC_ITEMS_SQL = f"""
SELECT doc_id AS item_id, CAST(DATE '{tb.DOC_EPOCH}' + CAST(doc_id % {tb.DOC_DAYS} AS INTEGER) AS DATE) AS date,
       1 AS kind, doc_id AS ord, text, n_chars AS score
FROM documents"""

SOCIAL_ITEMS_SQL = f"""
SELECT '0:' || id AS item_id, date, 0 AS kind, id AS ord, body AS text, score FROM ({COMMENTS_SQL})
UNION ALL
SELECT '1:' || id AS item_id, date, 1 AS kind, id AS ord, title AS text, score FROM ({POSTS_SQL})"""


@register("document_sentiment", f"""
SELECT item_id, date, (round((vader) * {NUDGE!r}, 9) + 0.0) AS vader, (round((textblob) * {NUDGE!r}, 9) + 0.0) AS textblob
FROM ({lexicon_scores_sql(DOC_ITEMS_SQL, ', items.date')})""")
def q_document_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T3 on whole documents: rule-based compound and mean-polarity scores per item."""
    items = tb.documents_as_items(tb.load(spark, sf, "documents"))
    s = lex.score_items(items, lex.lexicon_frame(spark), "item_id", keep=["date"])
    return s.select("item_id", "date", rnd("vader", 9), rnd("textblob", 9))


def _social_items(spark, sf, parity=False, with_body=True):
    return clean.union_items(_comments(spark, sf, with_body), _posts(spark, sf), parity=parity)


def _daily_social(spark, sf):
    return lex.daily_scores(_social_items(spark, sf), lex.lexicon_frame(spark))


def _scored_social_items(spark, sf):
    items = _social_items(spark, sf)
    return lex.score_items(items, lex.lexicon_frame(spark), "item_id", keep=["date", "score"])


DAILY_SOCIAL_SQL = f"""
SELECT date, avg(vader) AS avg_sentiment, avg(textblob) AS textblob_sentiment,
       avg(score) AS avg_score, count(*) AS item_count
FROM ({lexicon_scores_sql(SOCIAL_ITEMS_SQL, ', items.date, items.score')}) GROUP BY date"""


@register("daily_social", f"""
SELECT date, (round((avg_sentiment) * {NUDGE!r}, 9) + 0.0) AS avg_sentiment, (round((textblob_sentiment) * {NUDGE!r}, 9) + 0.0) AS textblob_sentiment,
       avg_score, item_count
FROM ({DAILY_SOCIAL_SQL})""")
def q_daily_social(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + T3 + A2: per-day mean scores, mean item score and item count over comments and posts."""
    d = _daily_social(spark, sf)
    return d.select("date", rnd("avg_sentiment", 9), rnd("textblob_sentiment", 9), "avg_score", "item_count")


# ---------------------------------------------------------------------------------------
# Market x social features (J6 + W9 with sentiment lags) and the statistics over them
# ---------------------------------------------------------------------------------------

MS_SQL = f"""
WITH bars AS ({BARS_SQL}),
soc AS ({DAILY_SOCIAL_SQL}),
dp AS ({DAILY_POSTS_SQL}),
j AS (SELECT bars.*, soc.avg_sentiment, soc.textblob_sentiment, soc.avg_score, soc.item_count,
             dp.engagement, dp.relevance, dp.mean_post_comments
      FROM bars JOIN soc USING (date) LEFT JOIN dp USING (date)),
r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM j),
f AS (SELECT *,
        CASE WHEN count(ret) OVER w7 = 7 THEN stddev_samp(ret) OVER w7 END AS volatility_7d,
        abs(ret) / nullif(volume, 0) AS illiquidity,
        CASE WHEN count(volume) OVER w30 = 30 THEN volume / nullif(avg(volume) OVER w30, 0) END AS turnover_ratio,
        lag(avg_sentiment, 1) OVER w AS sentiment_lag_1, lag(avg_sentiment, 2) OVER w AS sentiment_lag_2
      FROM r
      WINDOW w AS (PARTITION BY symbol ORDER BY date),
             w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
             w30 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN volatility_7d > median(volatility_7d) OVER (PARTITION BY symbol)
                     THEN 'High Volatility' ELSE 'Low Volatility' END AS market_regime FROM f),
feat AS (SELECT * RENAME (ret AS return) FROM g
         WHERE ret IS NOT NULL AND volatility_7d IS NOT NULL AND illiquidity IS NOT NULL
           AND turnover_ratio IS NOT NULL AND sentiment_lag_1 IS NOT NULL AND sentiment_lag_2 IS NOT NULL
           AND engagement IS NOT NULL AND relevance IS NOT NULL AND mean_post_comments IS NOT NULL
           AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL)"""


def _market_social(spark, sf, passes: int = 1):
    bars = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    social = rollups.social_table(_daily_social(spark, sf), None, _daily_posts(spark, sf))
    return ts.features(rollups.market_social(bars, social), sentiment="avg_sentiment", passes=passes)


@register("market_social_features", MS_SQL + f"""
SELECT symbol, date, close, volume, return, {r_sql('volatility_7d', 9)} AS volatility_7d, illiquidity,
       turnover_ratio, {r_sql('avg_sentiment', 9)} AS avg_sentiment,
       {r_sql('sentiment_lag_1', 9)} AS sentiment_lag_1, {r_sql('sentiment_lag_2', 9)} AS sentiment_lag_2,
       item_count, {r_sql('engagement', 6)} AS engagement, market_regime
FROM feat""")
def q_market_social_features(spark: SparkSession, sf: str) -> DataFrame:
    """J6 + W1-W6 + W9: market bars joined with the daily social table, full feature bundle."""
    f = _market_social(spark, sf)
    return f.select("symbol", "date", "close", "volume", "return", rnd("volatility_7d", 9), "illiquidity",
                    "turnover_ratio", rnd("avg_sentiment", 9), rnd("sentiment_lag_1", 9),
                    rnd("sentiment_lag_2", 9), "item_count", rnd("engagement", 6), "market_regime")


def _corr_sql(source_cte: str, cols: list[str]) -> str:
    parts = [f"SELECT '{a}' AS row, '{b}' AS col, {r_sql(f'corr({a}, {b})', 9)} AS corr FROM {source_cte}"
             for a in cols for b in cols]
    return "\nUNION ALL\n".join(parts)


_CORR_COLS = ["close", "volume", "return", "volatility_7d", "illiquidity", "turnover_ratio",
              "avg_sentiment", "item_count"]


@register("feature_correlations", MS_SQL + "\n" + _corr_sql("feat", _CORR_COLS))
def q_feature_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """8x8 Pearson matrix of the feature table in one aggregation (long form)."""
    c = stats.correlation_matrix(_market_social(spark, sf), _CORR_COLS)
    return c.select("row", "col", rnd("corr", 9))


@register("sentiment_histogram", MS_SQL + f""",
rg AS (SELECT CASE WHEN min(avg_sentiment) = max(avg_sentiment) THEN min(avg_sentiment) - 0.5 ELSE min(avg_sentiment) END AS lo,
              CASE WHEN min(avg_sentiment) = max(avg_sentiment) THEN max(avg_sentiment) + 0.5 ELSE max(avg_sentiment) END AS hi
       FROM feat WHERE avg_sentiment IS NOT NULL),
b AS (SELECT CAST(least(floor((avg_sentiment - lo) * 25 / (hi - lo)), 24) AS INTEGER) AS bin, count(*) AS n
      FROM feat, rg WHERE avg_sentiment IS NOT NULL GROUP BY 1)
SELECT g.bin, {r_sql('lo + g.bin * ((hi - lo) / 25)', 9)} AS lo, {r_sql('lo + (g.bin + 1) * ((hi - lo) / 25)', 9)} AS hi,
       CAST(coalesce(b.n, 0) AS BIGINT) AS count
FROM rg, (SELECT CAST(range AS INTEGER) AS bin FROM range(25)) g LEFT JOIN b ON g.bin = b.bin""")
def q_sentiment_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """25 equal-width bins of daily mean sentiment (last bin closed, empty bins kept)."""
    feats = pinned(_market_social(spark, sf).select("avg_sentiment"))  # read twice: range, then bins
    h = stats.histogram(feats, "avg_sentiment", 25)
    return h.select("bin", rnd("lo", 9), rnd("hi", 9), "count")


@register("volume_box", MS_SQL + f""",
q AS (SELECT quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.5) AS median,
             quantile_cont(volume, 0.75) AS q3 FROM feat),
fz AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q)
SELECT q1, median, q3, iqr, fence_lo, fence_hi,
       min(CASE WHEN volume >= fence_lo THEN volume END) AS whisker_lo,
       max(CASE WHEN volume <= fence_hi THEN volume END) AS whisker_hi,
       count(*) FILTER (WHERE volume < fence_lo OR volume > fence_hi) AS outliers, count(*) AS count
FROM feat, fz GROUP BY ALL""")
def q_volume_box(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quartiles, 1.5 IQR fences, whiskers and outlier count of daily volume."""
    return stats.box_stats(_market_social(spark, sf), "volume")


@register("lag_scatter", MS_SQL + """
SELECT CAST(floor(x / 0.01) AS BIGINT) AS x_bin, CAST(floor(illiquidity / 0.000001) AS BIGINT) AS y_bin,
       count(*) AS count
FROM (SELECT """ + r_sql("sentiment_lag_1", 9) + """ AS x, illiquidity FROM feat) GROUP BY ALL""")
def q_lag_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """W10 + E7: lagged sentiment vs illiquidity as 2-D binned counts."""
    # the lag is a mean (summation-order noise): bin its 9-decimal rounding, like the oracle
    pts = ts.lag_points(_market_social(spark, sf)).withColumn(
        "sentiment_lag_1", F.round(F.col("sentiment_lag_1") * F.lit(NUDGE), 9))
    return stats.binned_scatter(pts, "sentiment_lag_1", "illiquidity", 0.01, 0.000001)


@register("chronological_split", MS_SQL + """,
s AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
             count(*) OVER (PARTITION BY symbol) AS n FROM feat)
SELECT symbol, count(*) FILTER (WHERE rn <= n - ceil(n * 0.2)) AS n_train,
       count(*) FILTER (WHERE rn > n - ceil(n * 0.2)) AS n_test,
       min(date) FILTER (WHERE rn > n - ceil(n * 0.2)) AS first_test_date
FROM s GROUP BY symbol""")
def q_chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    """Per-symbol chronological 80/20 split (test = last ceil(0.2 n) rows)."""
    return _split_summary(ts.chronological_split(_market_social(spark, sf)))


@register("chronological_split_ranged", ORACLE["chronological_split"])
def q_chronological_split_ranged(spark: SparkSession, sf: str) -> DataFrame:
    """O5 for long series: the same split, its rows numbered over range partitions."""
    return _split_summary(ts.chronological_split(_market_social(spark, sf), ranged=True))


def _split_summary(s: DataFrame) -> DataFrame:
    return s.groupBy("symbol").agg(F.count_if(~F.col("is_test")).alias("n_train"),
                                   F.count_if(F.col("is_test")).alias("n_test"),
                                   F.min(F.when(F.col("is_test"), F.col("date"))).alias("first_test_date"))


# ---------------------------------------------------------------------------------------
# Scorer validation on whole documents: rule score, polarity score, human label score
# ---------------------------------------------------------------------------------------
DOC_SCORES_SQL = f"""
SELECT s.item_id, s.date, s.vader, s.textblob, CAST(l.quality - l.toxic AS DOUBLE) AS finbert
FROM ({lexicon_scores_sql(DOC_ITEMS_SQL, ', items.date')}) s LEFT JOIN labels l ON s.item_id = l.doc_id"""


def _doc_scores(spark, sf):
    items = tb.documents_as_items(tb.load(spark, sf, "documents"))
    s = lex.score_items(items, lex.lexicon_frame(spark), "item_id", keep=["date"])
    lab = tb.label_scores(tb.load(spark, sf, "labels"))
    return s.join(lab, s["item_id"] == lab["doc_id"], "left").drop("doc_id") \
        .withColumnRenamed("label_score", "finbert")


def _sql3(x):
    from murmur import config as cfg
    c = cfg.THREE_CLASS_CUT
    return f"CASE WHEN {x} > {c} THEN 'positive' WHEN {x} < -{c} THEN 'negative' ELSE 'neutral' END"


def _sql5(x):
    from murmur import config as cfg
    hi, mid = cfg.FIVE_CLASS_EXTREME, cfg.FIVE_CLASS_MILD
    return (f"CASE WHEN {x} >= {hi} THEN 'Extremely Positive' WHEN {x} >= {mid} THEN 'Positive' "
            f"WHEN {x} <= -{hi} THEN 'Extremely Negative' WHEN {x} <= -{mid} THEN 'Negative' ELSE 'Neutral' END")


_PAIRS = [("vader", "textblob"), ("vader", "finbert"), ("textblob", "finbert")]


def _kappa_sql(src: str) -> str:
    stacked = "\nUNION ALL\n".join(
        f"SELECT '{a} vs {b}' AS comparison, {_sql3(a)} AS la, {_sql3(b)} AS lb FROM {src}" for a, b in _PAIRS)
    return f""",
st AS ({stacked}),
cells AS (SELECT comparison, la, lb, count(*) AS n FROM st GROUP BY ALL),
tot AS (SELECT comparison, sum(n) AS total, sum(CASE WHEN la = lb THEN n END) AS diag FROM cells GROUP BY 1),
ra AS (SELECT comparison, la AS label, sum(n) AS na FROM cells GROUP BY ALL),
rb AS (SELECT comparison, lb AS label, sum(n) AS nb FROM cells GROUP BY ALL),
mg AS (SELECT comparison, sum(na * nb) AS pe_num FROM ra JOIN rb USING (comparison, label) GROUP BY 1),
k AS (SELECT comparison, total, coalesce(diag, 0) / CAST(total AS DOUBLE) AS po,
             coalesce(pe_num, 0) / (CAST(total AS DOUBLE) * total) AS pe FROM tot LEFT JOIN mg USING (comparison))
SELECT comparison, CAST(total AS BIGINT) AS sample_size,
       {r_sql('CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END', 9)} AS kappa FROM k"""


def _kappa_frame(scores: DataFrame) -> DataFrame:
    lab = scores.select(*[three_class(c).alias(c) for c in ("vader", "textblob", "finbert")])
    k = stats.cohen_kappa(lab, _PAIRS)
    return k.select("comparison", "sample_size", rnd("kappa", 9))


@register("scorer_agreement", f"WITH ds AS ({DOC_SCORES_SQL})" + _kappa_sql("ds"))
def q_scorer_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """D1 + A13 over every document: Cohen's kappa of the three scorers' 3-class labels."""
    return _kappa_frame(_doc_scores(spark, sf))


SAMPLE_SQL = f"""
ds AS ({DOC_SCORES_SQL}),
smp AS (SELECT * FROM ds ORDER BY md5('42:' || CAST(item_id AS VARCHAR)), item_id LIMIT 100)"""


@register("scorer_agreement_sample", "WITH " + SAMPLE_SQL + _kappa_sql("smp"))
def q_scorer_agreement_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O4 + T8: kappa on a reproducible 100-row sample (sampling is the feature here)."""
    return _kappa_frame(ordering.seeded_sample(_doc_scores(spark, sf), "item_id", 100))


@register("reliability_sample", "WITH " + SAMPLE_SQL + f"""
SELECT item_id, date, {r_sql('vader', 9)} AS vader, {r_sql('textblob', 9)} AS textblob, finbert,
       {_sql5('vader')} AS vader_label, {_sql5('textblob')} AS textblob_label, {_sql5('finbert')} AS finbert_label
FROM smp""")
def q_reliability_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O4 + T7 + D2: sampled items with the three scores and their five-class labels."""
    s = ordering.seeded_sample(_doc_scores(spark, sf), "item_id", 100)
    return s.select("item_id", "date", rnd("vader", 9), rnd("textblob", 9), "finbert",
                    *[five_class(c).alias(f"{c}_label") for c in ("vader", "textblob", "finbert")])


@register("reliability", f"""
WITH ds AS ({DOC_SCORES_SQL})
SELECT item_id, date, {r_sql('vader', 9)} AS vader, {r_sql('textblob', 9)} AS textblob, finbert,
       {_sql5('vader')} AS vader_label, {_sql5('textblob')} AS textblob_label, {_sql5('finbert')} AS finbert_label
FROM ds""")
def q_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """T7 + D2: every item with the three scores and their five-class labels."""
    return _doc_scores(spark, sf).select("item_id", "date", rnd("vader", 9), rnd("textblob", 9), "finbert",
                                         *[five_class(c).alias(f"{c}_label") for c in ("vader", "textblob", "finbert")])


@register("label_counts", f"WITH ds AS ({DOC_SCORES_SQL})\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS scorer, {_sql5(c)} AS label, count(*) AS count FROM ds GROUP BY ALL"
    for c in ("vader", "textblob", "finbert")))
def q_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """D2 counts: five-class label frequencies per scorer over all documents (one unpivot)."""
    s = _doc_scores(spark, sf)
    long = stats.unpivot(s.select("vader", "textblob", "finbert"), ["vader", "textblob", "finbert"], "scorer", "v")
    return long.groupBy("scorer", five_class("v").alias("label")).agg(F.count(F.lit(1)).alias("count"))


@register("scorer_correlations", f"WITH ds AS ({DOC_SCORES_SQL})\n" + _corr_sql("ds", ["vader", "textblob", "finbert"]))
def q_scorer_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson correlations of the three scorers over all documents."""
    c = stats.correlation_matrix(_doc_scores(spark, sf), ["vader", "textblob", "finbert"])
    return c.select("row", "col", rnd("corr", 9))


@register("scorer_histograms", f"""
WITH ds AS ({DOC_SCORES_SQL}),
lg AS (SELECT 'vader' AS scorer, vader AS v FROM ds UNION ALL SELECT 'textblob', textblob FROM ds
       UNION ALL SELECT 'finbert', finbert FROM ds),
rg AS (SELECT scorer, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
       FROM lg WHERE v IS NOT NULL GROUP BY scorer),
b AS (SELECT scorer, CAST(least(floor((v - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM lg JOIN rg USING (scorer) WHERE v IS NOT NULL GROUP BY ALL)
SELECT rg.scorer, g.bin, {r_sql('lo + g.bin * ((hi - lo) / 30)', 9)} AS lo,
       {r_sql('lo + (g.bin + 1) * ((hi - lo) / 30)', 9)} AS hi, CAST(coalesce(b.n, 0) AS BIGINT) AS count
FROM rg CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) g
LEFT JOIN b ON b.scorer = rg.scorer AND b.bin = g.bin""")
def q_scorer_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Three 30-bin histograms, each over its own range, from one unpivot + one aggregation."""
    s = _doc_scores(spark, sf)
    long = pinned(stats.unpivot(s.select("vader", "textblob", "finbert"), ["vader", "textblob", "finbert"],
                                "scorer", "v"))  # read twice: ranges, then bins
    h = stats.histogram(long, "v", 30, ["scorer"])
    return h.select("scorer", "bin", rnd("lo", 9), rnd("hi", 9), "count")


@register("scorer_boxes", f"""
WITH ds AS ({DOC_SCORES_SQL}),
lg AS (SELECT 'vader' AS scorer, vader AS v FROM ds UNION ALL SELECT 'textblob', textblob FROM ds
       UNION ALL SELECT 'finbert', finbert FROM ds),
q AS (SELECT scorer, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM lg GROUP BY scorer),
fz AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q)
SELECT scorer, {r_sql('q1', 9)} AS q1, {r_sql('median', 9)} AS median, {r_sql('q3', 9)} AS q3,
       {r_sql('iqr', 9)} AS iqr, {r_sql('fence_lo', 9)} AS fence_lo, {r_sql('fence_hi', 9)} AS fence_hi,
       {r_sql('min(CASE WHEN v >= fence_lo THEN v END)', 9)} AS whisker_lo,
       {r_sql('max(CASE WHEN v <= fence_hi THEN v END)', 9)} AS whisker_hi,
       count(*) FILTER (WHERE v < fence_lo OR v > fence_hi) AS outliers, count(*) AS count
FROM lg JOIN fz USING (scorer) WHERE v IS NOT NULL GROUP BY scorer, q1, median, q3, iqr, fence_lo, fence_hi""")
def q_scorer_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """E5: box statistics of the three scorers side by side (exact quartiles)."""
    s = _doc_scores(spark, sf)
    long = stats.unpivot(s.select("vader", "textblob", "finbert"), ["vader", "textblob", "finbert"], "scorer", "v")
    b = stats.box_stats(long, "v", ["scorer"])
    return b.select("scorer", *[rnd(c, 9) for c in ("q1", "median", "q3", "iqr", "fence_lo", "fence_hi",
                                                    "whisker_lo", "whisker_hi")], "outliers", "count")


@register("score_summary", f"""
WITH it AS ({SOCIAL_ITEMS_SQL})
SELECT count(score) AS count, avg(score) AS mean, {r_sql('stddev_samp(score)', 6)} AS std,
       min(score) AS min, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50,
       quantile_cont(score, 0.75) AS q75, max(score) AS max
FROM it""")
def q_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A10: count, mean, std, min, exact quartiles, max of the item score over all items."""
    items = _social_items(spark, sf, with_body=False)  # the score needs no text
    d = stats.describe(items.withColumn("score", F.col("score").cast("double")), "score")
    return d.select("count", "mean", rnd("std", 6), F.col("min").cast("bigint").alias("min"),
                    "q25", "q50", "q75", F.col("max").cast("bigint").alias("max"))


@register("top_comment_texts", f"""
WITH c AS ({COMMENTS_SQL})
SELECT body, count(*) AS count FROM c GROUP BY body ORDER BY count DESC, body NULLS FIRST LIMIT 10""")
def q_top_comment_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent comment texts (a top-k report)."""
    return stats.top_frequencies(_comments(spark, sf), "body", 10)


# ---------------------------------------------------------------------------------------
# Day-level text and model scoring (A5/F5, T4, T6, R1) over whole documents
# ---------------------------------------------------------------------------------------

CHUNKS_SQL = f"""
WITH items AS ({DOC_ITEMS_SQL}),
d AS (SELECT date, string_agg(coalesce(text, ''), ' ' ORDER BY kind, ord) AS t FROM items GROUP BY date),
c AS (SELECT date, t, unnest(range(0, greatest(1, CAST(ceil(length(t) / {_cfg.CHUNK_CHARS}) AS BIGINT)))) AS chunk FROM d)
SELECT date, CAST(chunk AS BIGINT) AS chunk, substring(t, CAST(chunk * {_cfg.CHUNK_CHARS} + 1 AS BIGINT), {_cfg.CHUNK_CHARS}) AS text
FROM c"""


def _doc_chunks(spark, sf):
    return textchunks.daily_chunks(tb.documents_as_items(tb.load(spark, sf, "documents")))


@register("daily_text_chunks", CHUNKS_SQL)
def q_daily_text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + F5 on whole texts: each day's documents joined by spaces, in 1,800-char chunks."""
    return _doc_chunks(spark, sf)


@register("daily_model_scores", f"""
SELECT date, CAST(0 AS DOUBLE) AS finbert_sentiment, count(*) AS chunks FROM ({CHUNKS_SQL}) GROUP BY date""")
def q_daily_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T4: every chunk of every day through the batch model scorer, averaged per day.
    With no model installed this is the original's offline result: neutral 0."""
    return scoring.daily_model_scores(_doc_chunks(spark, sf), scoring.neutral_factory)


@register("item_irony", """
SELECT doc_id AS item_id, 'UNKNOWN' AS sarcasm_label, CAST(0 AS DOUBLE) AS sarcasm_score FROM documents""")
def q_item_irony(spark: SparkSession, sf: str) -> DataFrame:
    """Irony label and score per document through the batch scorer (offline: UNKNOWN, 0)."""
    docs = tb.load(spark, sf, "documents").withColumnRenamed("doc_id", "item_id")
    return scoring.irony_scores(docs, ["item_id"], "text", scoring.neutral_factory)


# The same operators with a scorer that looks at the text.
def _share_sql(letter: str, text: str) -> str:
    return f"CAST(length({text}) - length(replace({text}, '{letter}', '')) AS DOUBLE) / greatest(1, length({text}))"


MEAN_SHARES = f"avg({_share_sql('e', 'text')} - {_share_sql('o', 'text')})"


@register("daily_letter_scores", f"""
SELECT date, {r_sql(MEAN_SHARES, 9)} AS score, count(*) AS chunks
FROM ({CHUNKS_SQL}) GROUP BY date""")
def q_daily_letter_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T4 + D3: every chunk of every day through a real batch scorer, averaged per day."""
    out = scoring.daily_model_scores(_doc_chunks(spark, sf), scoring.letter_factory, out_col="score")
    return out.select("date", rnd("score", 9), "chunks")


@register("document_letter_scores", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, substring(t, CAST(k * {_cfg.CHUNK_CHARS} + 1 AS BIGINT), {_cfg.CHUNK_CHARS}) AS text
      FROM (SELECT doc_id, t, unnest(range(0, greatest(1, CAST(ceil(length(t) / {_cfg.CHUNK_CHARS}) AS BIGINT)))) AS k FROM d))
SELECT doc_id AS item_id, {r_sql(MEAN_SHARES, 9)} AS score
FROM c GROUP BY doc_id""")
def q_document_letter_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T5 + D3: the mean chunk score of every whole document through a real batch scorer."""
    items = tb.load(spark, sf, "documents").withColumnRenamed("doc_id", "item_id")
    return scoring.item_model_scores(items, scoring.letter_factory, out_col="score").select("item_id", rnd("score", 9))


@register("item_letter_labels", f"""
WITH s AS (SELECT doc_id, {_share_sql('e', 't')} AS e, {_share_sql('o', 't')} AS o
           FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id AS item_id, CASE WHEN o > e THEN 'IRONIC' ELSE 'PLAIN' END AS sarcasm_label, greatest(e, o) AS sarcasm_score
FROM s""")
def q_item_letter_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label and score of every whole document through a real batch scorer."""
    docs = tb.load(spark, sf, "documents").withColumnRenamed("doc_id", "item_id")
    return scoring.irony_scores(docs, ["item_id"], "text", scoring.letter_factory)


@register("incremental_irony", ORACLE["item_letter_labels"])
def q_incremental_irony(spark: SparkSession, sf: str) -> DataFrame:
    """The irony job as an availableNow stream over the documents table (one file, or a folder of files),
    exactly-once into a versioned table under the shared checkpoint folder."""
    docs = f"{sf}/documents.parquet"
    source, glob = (docs, "*") if files.is_folder(spark, docs) else (sf, "documents.parquet")
    out = incremental.incremental_irony(
        spark, source, shared_scratch_path(spark, "irony-sink"), shared_scratch_path(spark, "irony-ckpt"),
        key_cols=["doc_id"], path_glob=glob, factory=scoring.letter_factory)
    return out.withColumnRenamed("doc_id", "item_id")


# ---------------------------------------------------------------------------------------
# Misses: many documents have no label, so labels are the parent side of the relation.
# ---------------------------------------------------------------------------------------
def _labels_and_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("doc_id").cast("string")
    posts = tb.load(spark, sf, "labels").select(key.alias("id"), F.col("quality").cast("string").alias("title"))
    return posts, tb.load(spark, sf, "documents").select(key.alias("id"), key.alias("link_id"), "source")


@register("document_label_relation", """
SELECT CAST(d.doc_id AS VARCHAR) AS id_comment, CAST(l.doc_id AS VARCHAR) AS id_post, CAST(l.quality AS VARCHAR) AS title,
       l.doc_id IS NOT NULL AS has_parent_post
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_document_label_relation(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + P11 where many rows have no parent."""
    return relations.relation(*_labels_and_documents(spark, sf)).select("id_comment", "id_post", "title", "has_parent_post")


@register("unlabelled_by_source", """
SELECT d.source, count(*) AS orphans FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY d.source""")
def q_unlabelled_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """J9 + P12: the rows without a parent by the anti join, counted by source."""
    return relations.orphans(*_labels_and_documents(spark, sf)).groupBy("source").agg(F.count(F.lit(1)).alias("orphans"))


# ---------------------------------------------------------------------------------------
# Models (M1-M6, A14, A15): not SQL-expressible -> rows-only check; OLS is unit-tested
# against a NumPy least-squares fit on a fixture.
# ---------------------------------------------------------------------------------------


def _model_features(spark, sf):
    """The full feature table of the original: market x social x posts, plus the daily
    model score of the day's texts (T4 over the social items' chunks). Each daily table is settled before the next."""
    bars = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    items = _social_items(spark, sf)
    daily_model = settled(scoring.daily_model_scores(textchunks.daily_chunks(items), scoring.neutral_factory))
    daily_social = settled(rollups.daily_social(_scored_social_items(spark, sf)))
    social = rollups.social_table(daily_social, daily_model, settled(_daily_posts(spark, sf)))
    return ts.features(rollups.market_social(bars, social), sentiment="avg_sentiment")


@register("model_predictions", None)
def q_model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M6: OLS, random forest and boosted trees on the chronological split; test predictions."""
    return ml.model_predictions(_model_features(spark, sf).drop("chunks"))


@register("model_results", None)
def q_model_results(spark: SparkSession, sf: str) -> DataFrame:
    """A14 + A15: MAE / RMSE / R^2 per model."""
    return ml.model_results(ml.model_predictions(_model_features(spark, sf).drop("chunks")))


# ---------------------------------------------------------------------------------------
# Blocked windows (very long series): same answers as the plain windows, checked by the
# same SQL. 500-row blocks, 48-row halo.
# ---------------------------------------------------------------------------------------
@register("least_squares", f"""
WITH f AS (SELECT illiquidity AS y, "return" AS a, volume AS b FROM ({ORACLE['liquidity_features']})),
c AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb,
        covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(y, y) AS yy, count(*) AS n FROM f),
s AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM c)
SELECT 'intercept' AS term, {r_sql('my - ca * ma - cb * mb', 9)} AS value FROM s
UNION ALL SELECT 'return', {r_sql('ca', 9)} FROM s UNION ALL SELECT 'volume', {r_sql('cb', 9)} FROM s
UNION ALL SELECT 'r2', {r_sql('(ca * ay + cb * byy) / yy', 9)} FROM s UNION ALL SELECT 'rows', {r_sql('CAST(n AS DOUBLE)', 9)} FROM s""")
def q_least_squares(spark: SparkSession, sf: str) -> DataFrame:
    """M2: least squares of the illiquidity on return and volume, against Cramer's rule."""
    features = QUERIES["liquidity_features"](spark, sf)
    fit = ml.least_squares(features, ["return", "volume"], "illiquidity")
    values = [("intercept", fit.intercept), *fit.coefficients.items(), ("r2", fit.r2), ("rows", float(fit.rows))]
    return spark.createDataFrame(values, "term string, value double").select("term", rnd("value", 9))


@register("liquidity_features_blocked", ORACLE["liquidity_features"])
def q_liquidity_features_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """W9 as blocked windows: per-(symbol, block) windows + halo, distributed median."""
    b = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    return _features_out(ts.features(b, sentiment=None, block_rows=500))


@register("kalman_smoothing_blocked", ORACLE["kalman_smoothing"])
def q_kalman_smoothing_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """W7+W8 as blocked windows (FIR start-up terms use the series-global row index)."""
    b = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    k = ts.kalman_features(b, block_rows=500)
    return k.select("symbol", "date", rnd("close"), rnd("kalman_close"), rnd("kalman_return", 9),
                    rnd("kalman_volatility", 9))


@register("document_model_scores", """
SELECT doc_id AS item_id, CAST(0 AS DOUBLE) AS finbert FROM documents""")
def q_document_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T5: row-level model score of every whole document (1,800-char chunks averaged);
    offline model -> neutral 0."""
    items = tb.load(spark, sf, "documents").withColumnRenamed("doc_id", "item_id")
    return scoring.item_model_scores(items, scoring.neutral_factory)


# ---------------------------------------------------------------------------------------
# More single-operator queries: U3, U1, E1, E4 rows, F8 distribution
# ---------------------------------------------------------------------------------------
@register("comments_dedup", f"""
WITH c AS (SELECT id, author, body, created_utc, score, 0 AS delivery FROM ({COMMENTS_SQL})
           UNION ALL
           SELECT id, author, body, created_utc, score * 2, 1 FROM ({COMMENTS_SQL}))
SELECT id, author, body, created_utc, arg_min(score, delivery) AS score
FROM c GROUP BY id, author, body, created_utc""")
def q_comments_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Comments delivered twice (the copy with a changed score); keep the first delivery
    per (id, author, body, created_utc)."""
    c = _comments(spark, sf).select("id", "author", "body", "created_utc", "score")
    twice = c.withColumn("delivery", F.lit(0)).unionByName(
        c.withColumn("score", F.col("score") * 2).withColumn("delivery", F.lit(1)))
    return clean.dedup_comments(twice, order_by="delivery").drop("delivery")


@register("social_items", f"""
SELECT item_id, date, kind, ord, text, score FROM ({SOCIAL_ITEMS_SQL})""")
def q_social_items(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + P1: comments then posts as one item table (date from epoch seconds, kind, order key)."""
    return _social_items(spark, sf)


@register("price_volume_series", f"""
SELECT symbol, date, close, volume FROM ({BARS_SQL})""")
def q_price_volume_series(spark: SparkSession, sf: str) -> DataFrame:
    """The close and volume series behind the price and volume figures."""
    return tb.bars_from_lineitem(tb.load(spark, sf, "lineitem")).select("symbol", "date", "close", "volume")


@register("volume_outliers", MS_SQL + """,
q AS (SELECT quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.75) AS q3 FROM feat)
SELECT symbol, date, volume FROM feat, q
WHERE volume < q1 - 1.5 * (q3 - q1) OR volume > q3 + 1.5 * (q3 - q1)""")
def q_volume_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """The daily rows whose volume lies outside the 1.5 IQR fences."""
    f = pinned(_market_social(spark, sf).select("symbol", "date", "volume"))  # read twice
    return stats.outliers(f, "volume", stats.box_stats(f, "volume"))


@register("post_topics", f"""
WITH p AS ({POSTS_SQL})
SELECT {_topic_sql('p.title', DATA_TOPICS, DATA_TOPIC_DEFAULT)} AS topic,
       {_relevance_sql('p.title', DATA_KEYWORDS)} AS relevance, count(*) AS posts
FROM p GROUP BY ALL""")
def q_post_topics(spark: SparkSession, sf: str) -> DataFrame:
    """F7 + F8: how posts distribute over topics and relevance scores."""
    p = _posts(spark, sf)
    return p.groupBy(relations.topic_col("title", DATA_TOPICS, DATA_TOPIC_DEFAULT).alias("topic"),
                     relations.relevance_col("title", DATA_KEYWORDS).alias("relevance")) \
        .agg(F.count(F.lit(1)).alias("posts"))


@register("conversation_threads", """
WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS id, role AS author FROM conversations WHERE turn = 0),
r AS (SELECT concat_ws('-', conv_id, turn) AS id, role AS author,
             '/r/chat/comments/' || CAST(conv_id AS VARCHAR) || '/turn_' || CAST(turn AS VARCHAR) || '/' AS permalink
      FROM conversations WHERE turn > 0),
c AS (SELECT id, author, nullif(regexp_extract(permalink, '/comments/([^/]+)/', 1), '') AS link_id FROM r)
SELECT c.id AS id_comment, c.link_id, p.id AS id_post, c.author AS author_comment, p.author AS author_post,
       p.id IS NOT NULL AS has_parent_post
FROM c LEFT JOIN p ON c.link_id = p.id""")
def q_conversation_threads(spark: SparkSession, sf: str) -> DataFrame:
    """F3 + J1 + P11: replies find their thread through the permalink (no link id column)."""
    posts, replies = tb.threads_from_conversations(tb.load(spark, sf, "conversations"))
    rel = relations.relation(posts, replies)
    return rel.select("id_comment", "link_id", "id_post", "author_comment", "author_post", "has_parent_post")


def _feature_pass_sql(src: str, tag: str) -> str:
    """CTEs r<tag>, f<tag>, g<tag>, p<tag> computing one feature pass over CTE ``src``;
    p<tag> keeps the complete rows (the pass's drop of incomplete rows)."""
    return f"""
r{tag} AS (SELECT symbol, date, open, high, low, close, volume,
                  close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM {src}),
f{tag} AS (SELECT *,
        CASE WHEN count(ret) OVER w7 = 7 THEN stddev_samp(ret) OVER w7 END AS volatility_7d,
        abs(ret) / nullif(volume, 0) AS illiquidity,
        CASE WHEN count(volume) OVER w30 = 30 THEN volume / nullif(avg(volume) OVER w30, 0) END AS turnover_ratio
      FROM r{tag}
      WINDOW w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
             w30 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
g{tag} AS (SELECT *, CASE WHEN volatility_7d > median(volatility_7d) OVER (PARTITION BY symbol)
                          THEN 'High Volatility' ELSE 'Low Volatility' END AS market_regime FROM f{tag}),
p{tag} AS (SELECT * FROM g{tag}
           WHERE ret IS NOT NULL AND volatility_7d IS NOT NULL AND illiquidity IS NOT NULL
             AND turnover_ratio IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL)"""


@register("liquidity_features_two_pass", f"""
WITH bars AS ({BARS_SQL}),{_feature_pass_sql('bars', '1')},{_feature_pass_sql('p1', '2')}
SELECT symbol, date, close, volume, ret AS return, {r_sql('volatility_7d', 9)} AS volatility_7d,
       illiquidity, turnover_ratio, market_regime
FROM p2""")
def q_liquidity_features_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    """W9 applied twice, as the original main flow does (each pass recomputes returns,
    windows and the median on the rows that survived the previous pass)."""
    b = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    return _features_out(ts.features(b, sentiment=None, passes=2))


@register("post_comment_relation_salted", ORACLE["post_comment_relation"])
def q_post_comment_relation_salted(spark: SparkSession, sf: str) -> DataFrame:
    """J1 with explicit salting (16 salts): same rows as the plain join."""
    rel = relations.relation(_posts(spark, sf), _comments(spark, sf, with_body=False), salt=16)
    return rel.select("id_comment", "link_id", "id_post", "title", "author_comment", "author_post",
                      "has_parent_post")


_HOT_COMMENTS = f"""
SELECT * REPLACE (CASE WHEN CAST(link_id AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(link_id AS BIGINT) % 3 = 0
                       THEN (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders) ELSE link_id END AS link_id) FROM ({COMMENTS_SQL})"""


@register("post_comment_relation_skewed", ORACLE["post_comment_relation"].replace(COMMENTS_SQL, _HOT_COMMENTS))
def q_post_comment_relation_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """J1 with a third of all comments on one post and a seventh on none."""
    posts, comments = _posts(spark, sf), _comments(spark, sf, with_body=False)
    one = F.concat(F.lit("t3_"), F.lit(posts.agg(F.min(F.col("id").cast("long"))).first()[0]).cast("string"))
    key = F.regexp_replace("link_id", "^t3_", "").cast("long")
    skewed = comments.withColumn("link_id", F.when(key % 7 == 0, None).when(key % 3 == 0, one).otherwise(F.col("link_id")))
    rel = relations.relation_of_skewed(posts, skewed)
    return rel.select("id_comment", "link_id", "id_post", "title", "author_comment", "author_post",
                      "has_parent_post")


@register("median_sketch", f"""
SELECT symbol, count(*) AS rows, true AS within FROM ({ORACLE['liquidity_features']}) GROUP BY symbol""")
def q_median_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """A7 by the mergeable sketch: the rank of each symbol's sketched median is within the stated error of the middle."""
    rows = pinned(ts.features(tb.bars_from_lineitem(tb.load(spark, sf, "lineitem")), sentiment=None))
    med = ts.sketched_median(rows, "volatility_7d", ["symbol"])
    below = rows.join(med, "symbol").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("volatility_7d") < F.col("_med")).cast("int")).alias("lo"),
        F.avg((F.col("volatility_7d") <= F.col("_med")).cast("int")).alias("hi"))
    error = F.lit(ts.RANK_ERROR)
    return below.select("symbol", "rows", ((F.col("lo") <= 0.5 + error) & (F.col("hi") >= 0.5 - error)).alias("within"))


GAPS_Q, GAPS_R = 0.3, 2.0


@register("kalman_gaps", f"""
WITH RECURSIVE bars AS (SELECT symbol, date, CASE WHEN dayofyear(date) % 9 < 2 THEN NULL ELSE close END AS close FROM ({BARS_SQL})),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM bars
      WHERE date >= (SELECT min(date) FROM bars f WHERE f.symbol = bars.symbol AND f.close IS NOT NULL)),
k AS (SELECT symbol, t, close AS x, CAST({GAPS_R} / (1 + {GAPS_R}) AS DOUBLE) AS p FROM b WHERE t = 1
      UNION ALL
      SELECT b.symbol, b.t, CASE WHEN close IS NULL THEN x ELSE x + (p + {GAPS_Q}) / (p + {GAPS_Q} + {GAPS_R}) * (close - x) END,
        CASE WHEN close IS NULL THEN p + {GAPS_Q} ELSE {GAPS_R} * (p + {GAPS_Q}) / (p + {GAPS_Q} + {GAPS_R}) END
      FROM k JOIN b ON b.symbol = k.symbol AND b.t = k.t + 1)
SELECT symbol, date, {r_sql('x', 6)} AS kalman_close
FROM bars LEFT JOIN (SELECT symbol, date, x FROM b JOIN k USING (symbol, t)) USING (symbol, date)""")
def q_kalman_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """W7 as an associative scan over range partitions: closes missing for two days in nine, other noises than 1."""
    bars = tb.bars_from_lineitem(tb.load(spark, sf, "lineitem"))
    bars = bars.withColumn("close", F.when(F.dayofyear("date") % 9 < 2, None).otherwise(F.col("close")))
    out = affine.kalman_scan(bars, transition_noise=GAPS_Q, observation_noise=GAPS_R, num_partitions=11)
    return out.select("symbol", "date", rnd("kalman_close", 6))


# ---------------------------------------------------------------------------------------
# The day-level score through its joins, and a predictor that SQL can compute
# ---------------------------------------------------------------------------------------
_DAY_SCORES_SQL = f"SELECT date, {MEAN_SHARES} AS day_score FROM ({CHUNKS_SQL}) GROUP BY date"


@register("daily_scored_social", f"""
WITH scored AS ({lexicon_scores_sql(DOC_ITEMS_SQL, ', items.date, items.score')}), d AS ({_DAY_SCORES_SQL}),
items AS (SELECT s.*, d.day_score FROM scored s LEFT JOIN d USING (date))
SELECT date, {r_sql('avg(vader)', 9)} AS avg_sentiment, {r_sql('avg(score)', 6)} AS avg_score, count(*) AS item_count,
       {r_sql('avg(items.day_score)', 9)} AS item_day_score, {r_sql('any_value(d.day_score)', 9)} AS finbert_sentiment
FROM items JOIN d USING (date) GROUP BY date""")
def q_daily_scored_social(spark: SparkSession, sf: str) -> DataFrame:
    """A day score that moves with the text, joined to the items, averaged again per day, and joined to the day."""
    items = tb.documents_as_items(tb.load(spark, sf, "documents"))
    daily = scoring.daily_model_scores(textchunks.daily_chunks(items), scoring.letter_factory)
    scored = lex.score_items(items, lex.lexicon_frame(spark), "item_id", keep=["date", "score"])
    scored = rollups.attach_daily(scored, daily.withColumnRenamed("finbert_sentiment", "finbert"), "finbert")
    days = rollups.daily_social(scored).withColumnRenamed("finbert_sentiment", "item_day_score")
    return rollups.social_table(days, daily, None).select("date", rnd("avg_sentiment", 9), rnd("avg_score", 6), "item_count", rnd("item_day_score", 9), rnd("finbert_sentiment", 9))


@register("rescored_market", f"""
WITH bars AS ({EVENT_BARS_SQL}), d AS ({_DAY_SCORES_SQL.replace(CHUNKS_SQL, CHUNKS_SQL.replace(DOC_ITEMS_SQL, f"SELECT * FROM ({DOC_ITEMS_SQL}) WHERE day(date) % 4 <> 0"))}),
m AS (SELECT symbol, date, {r_sql('coalesce(day_score, 0)', 9)} AS finbert_sentiment FROM bars LEFT JOIN d USING (date))
SELECT *, (SELECT count(*) FROM m WHERE finbert_sentiment <> 0) AS non_zero FROM m""")
def q_rescored_market(spark: SparkSession, sf: str) -> DataFrame:
    """A stale day score replaced for the dates of the market table; days without a text get 0."""
    merged = tb.bars_from_events(tb.load(spark, sf, "events")).withColumn("finbert_sentiment", F.lit(-1.0))
    items = tb.documents_as_items(tb.load(spark, sf, "documents")).where(F.dayofmonth("date") % 4 != 0)
    out = pipelines.rescore_daily(merged.withColumn("avg_sentiment", F.lit(0.0)), items, scoring.letter_factory)
    some = out["summary"].select("non_zero").first()[0]
    return out["merged"].select("symbol", "date", rnd("finbert_sentiment", 9)).withColumn("non_zero", F.lit(some))


@register("least_squares_results", f"""
WITH f AS (SELECT symbol, date, illiquidity AS y, "return" AS a, volume AS b,
             row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ({ORACLE['liquidity_features']})),
c AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb,
        covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM f WHERE rn <= n - ceil(n * 0.2)),
s AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM c),
p AS (SELECT y AS actual, my - ca * ma - cb * mb + ca * a + cb * b AS predicted FROM f, s WHERE rn > n - ceil(n * 0.2)),
l AS (SELECT 'linear_regression' AS model, actual, predicted FROM p UNION ALL SELECT 'no_change', actual, actual FROM p)
SELECT model, {r_sql('avg(abs(actual - predicted))', 9)} AS mae, {r_sql('sqrt(avg((actual - predicted) ** 2))', 9)} AS rmse,
       {r_sql('1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))', 9)} AS r2
FROM l GROUP BY model""")
def q_least_squares_results(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares on the first 80 % of each series, judged on the last 20 %, beside the perfect one."""
    features = QUERIES["liquidity_features"](spark, sf).withColumn("y", F.col("illiquidity"))
    split = pinned(ts.chronological_split(features))
    fit = ml.least_squares(split.where(~F.col("is_test")), ["return", "volume"], "y")
    preds = split.where("is_test").select(F.col("y").alias("actual"), fit.predict().alias("linear_regression"), F.col("y").alias("no_change"))
    return ml.model_results(preds, ("linear_regression", "no_change")).select("model", rnd("mae", 9), rnd("rmse", 9), rnd("r2", 9))


from murmur.plans import pipelines  # noqa: E402 - its modules need none of the above
from murmur.plans import deliveries  # noqa: E402,F401 - registers its queries
