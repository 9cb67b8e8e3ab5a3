"""The original end-to-end flows composed from the operators.

A flow is a list of steps (:mod:`murmur.plans.artifacts`): ``graph(...).materialise`` stores each result once and
resumes, ``full`` and its parts give the same steps as a dict of lazy frames. The only actions while plans are
built are bounded: the lexicon size check, offsets, the model-fitting jobs.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from murmur import config
from murmur.config import RunOptions
from murmur.functions.labels import five_class, three_class
from murmur.operators import clean, lexicon as lex, ml, relations, rollups, scoring, stats, textchunks
from murmur.operators import timeseries as ts
from murmur.operators.joins import replace_column, semi_prune
from murmur.plans.artifacts import ArtifactGraph, Step
from murmur.sources import files


@dataclass
class Inputs:
    posts: DataFrame                      # id, author, title, created_utc, score
    comments: DataFrame                   # id, author, body, created_utc, score, link_id | permalink
    bars: DataFrame                       # symbol, date, open, high, low, close, volume (typed)
    lexicon: DataFrame                    # term, valence
    day_model: scoring.ScorerFactory | None = scoring.neutral_factory
    item_model: scoring.ScorerFactory | None = scoring.neutral_factory
    irony_model: scoring.ScorerFactory | None = scoring.neutral_factory
    options: RunOptions = field(default_factory=RunOptions)


def quality_counters(stages: dict[str, DataFrame]) -> DataFrame:
    """``(stage, rows)`` for each named frame — one-row aggregates unioned, computed
    when the artifact is written (no driver round trip per stage)."""
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
              for name, df in stages.items()]
    return functools.reduce(DataFrame.unionByName, frames)


def box_by_scorer(scored: DataFrame) -> DataFrame:
    long = stats.unpivot(scored.select(*config.SCORER_COLUMNS), config.SCORER_COLUMNS, "scorer", "v")
    return stats.box_stats(long, "v", ["scorer"])


def hist_by_scorer(scored: DataFrame, bins: int = 30) -> DataFrame:
    long = stats.unpivot(scored.select(*config.SCORER_COLUMNS), config.SCORER_COLUMNS, "scorer", "v")
    return stats.histogram(long, "v", bins, ["scorer"])


SCORER_PAIRS = [("vader", "textblob"), ("vader", "finbert"), ("textblob", "finbert")]


def scatter_by_pair(scored: DataFrame, width: float = 0.05) -> DataFrame:
    """E7 for each pair of scorers: ``(comparison, x_bin, y_bin, count)``."""
    pairs = scored.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in SCORER_PAIRS])).alias("p"))
    return stats.binned_scatter(pairs.select("p.*"), "x", "y", width, width, ["comparison"])


def preprocess_steps(inp: Inputs) -> list[Step]:
    """Cleaned posts with counts/tags/engagement, the relation with its orphan flag,
    the Kalman-smoothed daily market table."""
    o = inp.options

    def relation(posts, comments):
        return relations.relation(posts, comments, parity=o.parity)

    def posts_enriched(posts, comments, relation):
        counts = relations.comment_counts(comments, parity_relation=relation if o.parity else None)
        return relations.enrich_posts(relations.posts_with_counts(posts, counts), o.keywords, o.topics, o.topic_default, parity=o.parity)

    def quality(posts, comments, orphans):
        return quality_counters({"posts_after_dedup": posts, "comments_after_dedup": comments, "orphan_comments": orphans})

    return [
        Step("posts", lambda: clean.dedup_posts(clean.add_date(inp.posts))),
        Step("comments", lambda: clean.dedup_comments(clean.add_date(inp.comments))),
        Step("relation", relation),
        Step("posts_enriched", posts_enriched),
        Step("orphans", lambda relation: relation.where(~F.col("has_parent_post"))),
        Step("daily_market", lambda: ts.kalman_features(inp.bars)),
        Step("quality_counters", quality),
    ]


def scoring_steps(inp: Inputs) -> list[Step]:
    """U1 + T3 + T5 + T6 (one pass over the texts), A5/F5 + T4 + J3 (the day's text), and C6: labels, kappa,
    distributions of the scorers."""

    def item_scores(items):
        both = scoring.rescored(items, "text", inp.item_model, inp.irony_model)
        return lex.score_items(both, inp.lexicon, "item_id", keep=["date", "score", "finbert", "sarcasm_label", "sarcasm_score"])

    def scored_items(item_scores, daily_model):
        rules = item_scores.select("item_id", "date", "score", "vader", "textblob")
        return rollups.attach_daily(rules, daily_model.withColumnRenamed("finbert_sentiment", "finbert"), "finbert")

    def reliability(item_scores):
        each = item_scores.select("item_id", "date", "score", *config.SCORER_COLUMNS)
        return each.select("*", *[five_class(c).alias(f"{c}_label") for c in config.SCORER_COLUMNS])

    def kappa(item_scores):
        return stats.cohen_kappa(item_scores.select(*[three_class(c).alias(c) for c in config.SCORER_COLUMNS]), SCORER_PAIRS)

    return [
        Step("items", lambda comments, posts: clean.union_items(comments, posts, parity=inp.options.parity)),
        Step("item_scores", item_scores),
        Step("daily_text_chunks", lambda items: textchunks.daily_chunks(items, config.CHUNK_CHARS, order_cols=clean.item_order(items))),
        Step("daily_model", lambda daily_text_chunks: scoring.daily_model_scores(daily_text_chunks, inp.day_model)),
        Step("scored_items", scored_items),
        Step("reliability", reliability),
        Step("kappa", kappa),
        Step("sarcasm", lambda item_scores: item_scores.select("item_id", "sarcasm_label", "sarcasm_score")),
        Step("scorer_correlation", lambda scored_items: stats.correlation_matrix(scored_items, config.SCORER_COLUMNS)),
        Step("scorer_boxes", lambda scored_items: box_by_scorer(scored_items)),
        Step("scorer_histograms", lambda scored_items: hist_by_scorer(scored_items)),
        Step("scorer_scatter", lambda scored_items: scatter_by_pair(scored_items)),
    ]


def report_steps(options: RunOptions, run_models: bool = True) -> list[Step]:
    """EDA data (E1-E7, A8) and the three regressors with their results."""

    def model_predictions(features):
        return ml.model_predictions(features.drop("chunks"), label_scale=1.0 if options.parity else options.label_scale,
                                    lagged_only=options.lagged_only)

    eda = [
        Step("close_series", lambda features: features.select("symbol", "date", "close")),
        Step("volume_series", lambda features: features.select("symbol", "date", "volume")),
        Step("sentiment_histogram", lambda features: stats.histogram(features, "avg_sentiment", 25)),
        Step("volume_box", lambda features: stats.box_stats(features, "volume")),
        Step("volume_outliers", lambda features, volume_box: stats.outliers(features.select("symbol", "date", "volume"), "volume", volume_box)),
        Step("correlation_matrix", lambda features: stats.correlation_matrix(features, config.CORRELATION_COLUMNS)),
        Step("lag_points", lambda features: ts.lag_points(features)),
    ]
    models = [Step("model_predictions", model_predictions), Step("model_results", lambda model_predictions: ml.model_results(model_predictions))]
    return eda + (models if run_models else [])


def graph(inp: Inputs, run_models: bool = True) -> ArtifactGraph:
    """The whole flow as steps."""
    o = inp.options

    def daily_social(scored_items, daily_model, posts_enriched):
        return rollups.social_table(rollups.daily_social(scored_items.drop("finbert")), daily_model, rollups.daily_posts(posts_enriched))

    return ArtifactGraph([
        *preprocess_steps(inp), *scoring_steps(inp),
        Step("daily_social", daily_social),
        Step("merged", lambda daily_market, daily_social: rollups.market_social(daily_market, daily_social)),
        Step("features", lambda merged: ts.features(merged, sentiment="avg_sentiment", passes=2 if o.parity else o.feature_passes)),
        *report_steps(o, run_models),
    ])


def full(inp: Inputs, run_models: bool = True) -> dict[str, DataFrame]:
    """C1 without storing anything: every step as a plan over the inputs."""
    return graph(inp, run_models).lazy()


def preprocess(inp: Inputs) -> dict[str, DataFrame]:
    """C3 alone."""
    return ArtifactGraph(preprocess_steps(inp)).lazy()


def model_and_report(features: DataFrame, options: RunOptions | None = None) -> dict[str, DataFrame]:
    """C2 alone, on a given feature table."""
    out = ArtifactGraph([Step("features", lambda: features), *report_steps(options or RunOptions())]).lazy()
    return {k: v for k, v in out.items() if k != "features"}


def summary(scored: DataFrame, columns: list[str]) -> DataFrame:
    """A10 + P12 of re-scored rows: ``(scorer, count, mean, std, min, q25, q50, q75, max, non_zero)``."""
    long = stats.unpivot(scored.select(*columns), columns, "scorer", "v")
    some = long.groupBy("scorer").agg(F.count_if(F.col("v") != 0).alias("non_zero"))
    return stats.describe(long, "v", ["scorer"]).join(some, "scorer")


def raw_daily_items(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """S7 + U1 of the re-scoring job: every comment's body and post's title with a date and a text, repeated ones too."""
    def side(df, text, kind):
        order = clean.available(df, files.ORDINAL)
        rows = df.select("id", "created_utc", F.col(text).cast("string").alias("text"), *order).na.drop("any", subset=["created_utc", "text"])
        return clean.add_date(rows, keep_timestamp=False).select("date", F.lit(kind).alias("kind"), F.col("id").alias("ord"), "text", *order)
    return side(comments, "body", 0).unionByName(side(posts, "title", 1))


def rescore_daily(merged: DataFrame, items: DataFrame, factory: scoring.ScorerFactory | None,
                  options: RunOptions | None = None) -> dict[str, DataFrame]:
    """C4: rebuild the day-level model score for the dates present in ``merged`` only
    (semi-join below the scorer), replace the column, recompute features once, summarise the new scores.
    ``items``: those of C1, or :func:`raw_daily_items` as the original's job takes them."""
    wanted = semi_prune(items, merged, ["date"])
    chunks = textchunks.daily_chunks(wanted, config.CHUNK_CHARS, order_cols=clean.item_order(wanted))
    daily = scoring.daily_model_scores(chunks, factory)
    refreshed = replace_column(merged, daily, ["date"], "finbert_sentiment", 0.0)
    return {"merged": refreshed, "features": ts.features(refreshed.drop("chunks"), sentiment="avg_sentiment"),
            "summary": summary(refreshed, ["finbert_sentiment"])}


def rescore_items(spark, source_dir: str, sink_path: str, checkpoint_path: str, key_cols: list[str],
                  model: scoring.ScorerFactory | None = None, irony: scoring.ScorerFactory | None = None,
                  **kw) -> DataFrame:
    """Incremental re-scoring of newly arrived item files (see ``streaming.incremental``)."""
    from murmur.streaming.incremental import rescore_items as _run
    return _run(spark, source_dir, sink_path, checkpoint_path, key_cols, model=model, irony=irony, **kw)


def clean_social(df: DataFrame) -> DataFrame:
    """Single-file social preprocess (date from epoch, drop incomplete rows)."""
    return clean.clean_items(df)
