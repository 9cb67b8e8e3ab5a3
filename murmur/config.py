"""Fixed values and run options.

Fixed values below must equal the published behaviour of the original pipeline and of the
public scorers it calls; they are stated as plain text, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------
# FIXED VALUES (must equal the original pipeline's behaviour)
# ---------------------------------------------------------------------------------------
# Relevance keywords, each counted once when it occurs as a substring of the lower-cased title.
RELEVANCE_KEYWORDS = [
    "tesla", "tsla", "elon", "musk",
    "cybertruck", "model 3", "model y",
    "gigafactory", "fsd",
]
# Topic rules: first match wins; a rule matches when any of its substrings occurs.
TOPIC_RULES = [
    ("Earnings", ["earnings"]),
    ("Elon Musk", ["elon", "musk"]),
    ("Deliveries", ["delivery"]),
    ("Bitcoin", ["bitcoin"]),
    ("Autopilot", ["autopilot"]),
    ("Stock Market", ["stock", "price"]),
]
TOPIC_DEFAULT = "General Tesla"
# Three-class labels: strictly above / below +-0.05, otherwise (and missing) neutral.
THREE_CLASS_CUT = 0.05
# Five-class labels, checked in this order with >= / <=.
FIVE_CLASS_EXTREME = 0.75
FIVE_CLASS_MILD = 0.25
# Slice of text given to a model at once, and texts in one call.
CHUNK_CHARS = 1800
SCORER_BATCH = 64
SAMPLE_SEED = 42
TEST_FRACTION = 0.2
# Rolling windows (rows) and lags.
VOL_WINDOW = 7
TURNOVER_WINDOW = 30
SENTIMENT_LAGS = [1, 2]
# Regressor settings of the original pipeline.
RF_TREES, RF_DEPTH = 200, 10
GBT_ROUNDS, GBT_STEP, GBT_DEPTH = 200, 0.05, 6
MODEL_SEED = 42
# Model feature columns in the original order (snake_case names of this engine).
MODEL_FEATURES = [
    "close", "volume", "return", "volatility_7d", "turnover_ratio",
    "avg_sentiment", "textblob_sentiment", "finbert_sentiment",
    "item_count", "avg_score", "sentiment_lag_1", "sentiment_lag_2",
    "engagement", "relevance",
]
CORRELATION_COLUMNS = [
    "close", "volume", "return", "volatility_7d", "illiquidity",
    "turnover_ratio", "avg_sentiment", "item_count",
]
SCORER_COLUMNS = ["vader", "textblob", "finbert"]
# Public constants of the rule-based compound score (Hutto & Gilbert, 2014).
COMPOUND_ALPHA = 15.0
NEGATION_SCALAR = -0.74
NEGATION_LOOKBACK = 3
NEGATORS = [
    "not", "no", "never", "nor", "neither", "none", "nobody", "nothing",
    "nowhere", "without", "cannot", "isnt", "dont", "doesnt", "didnt", "wont",
]
# Mean-polarity score: valences are divided by this to land in [-1, 1]; negation factor.
POLARITY_SCALE = 4.0
POLARITY_NEGATION = -0.5
# ---------------------------------------------------------------------------------------


@dataclass
class RunOptions:
    """Switches for the places where the original behaviour is questionable.

    parity=True keeps the original's treatment of missing texts and links; its bounds on text,
    chunks and validation rows are not offered: every row and every character counts.
    """

    parity: bool = False
    feature_passes: int = 1                  # original main flow applies features twice
    label_scale: float = 1e9                 # original: 1 (trees underflow on 1e-10 labels)
    lagged_only: bool = False                # drop same-row return/volume from model inputs
    keywords: list = field(default_factory=lambda: list(RELEVANCE_KEYWORDS))
    topics: list = field(default_factory=lambda: list(TOPIC_RULES))
    topic_default: str = TOPIC_DEFAULT
