"""Daily rollups and the market/social joins.

Daily frames hold one row per day (a calendar bound, not a data bound). Joins against
them are left to AQE, which turns them into broadcast joins from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_social(scored_items: DataFrame, date_col: str = "date") -> DataFrame:
    """A2/A3: per day mean rule score, mean polarity score, mean item score, item count
    (and mean model score when a ``finbert`` column is present)."""
    aggs = [F.avg("vader").alias("avg_sentiment"),
            F.avg("textblob").alias("textblob_sentiment"),
            F.avg("score").alias("avg_score"),
            F.count(F.lit(1)).alias("item_count")]
    if "finbert" in scored_items.columns:
        aggs.append(F.avg("finbert").alias("finbert_sentiment"))
    return scored_items.groupBy(date_col).agg(*aggs)


def daily_posts(enriched_posts: DataFrame, date_col: str = "date") -> DataFrame:
    """A4: per day mean engagement, relevance and comments per post."""
    return enriched_posts.groupBy(date_col).agg(
        F.avg("engagement").alias("engagement"),
        F.avg("relevance").alias("relevance"),
        F.avg("comment_count").alias("mean_post_comments"))


def attach_daily(items: DataFrame, daily: DataFrame, column: str, date_col: str = "date") -> DataFrame:
    """Left-join a per-day value onto per-item or per-day rows."""
    return items.join(daily.select(date_col, column), date_col, "left")


def social_table(daily_soc: DataFrame, daily_model: DataFrame | None, daily_post: DataFrame | None,
                 date_col: str = "date") -> DataFrame:
    """J4 + J5: the daily social table."""
    out = daily_soc
    if daily_model is not None:
        out = out.join(daily_model.select(date_col, "finbert_sentiment"), date_col, "left")
    if daily_post is not None:
        out = out.join(daily_post, date_col, "left")
    return out


def market_social(market: DataFrame, social: DataFrame, date_col: str = "date") -> DataFrame:
    """Inner join on the date (and the symbol when the social side carries one)."""
    on = [date_col] + (["symbol"] if "symbol" in social.columns and "symbol" in market.columns else [])
    return market.join(social, on, "inner")
