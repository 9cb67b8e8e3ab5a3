"""Row-based time-series operators over a panel of symbols.

All look-backs are bounded (lag 2, 7+1 rows, 30 rows, Kalman horizon 40), and every window
is partitioned by the panel key, so one exchange on the key feeds all of them and no
window ever plans ``SinglePartition``. A daily series is thousands of rows per symbol even
when the raw input is huge: the raw rows are reduced by a partial (map-side) aggregation
before this point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmur import config
from murmur.functions.numeric import safe_ratio
from murmur.session import ensure_checkpoint_dir

PHI = (1.0 + math.sqrt(5.0)) / 2.0
_R = -1.0 / (PHI * PHI)            # psi / phi
KALMAN_HORIZON = 40                # phi^-80 ~ 2e-17: the rest of the past is below double precision


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def simple_return(price: str, w) -> Column:
    """x_t / x_{t-1} - 1 (NULL on the first row or a zero previous price)."""
    return safe_ratio(F.col(price), F.lag(price).over(w)) - F.lit(1.0)


def rolling_std(c: str, w, n: int) -> Column:
    """Sample std over the last ``n`` rows, only when all ``n`` are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, F.stddev_samp(c).over(frame))


def rolling_mean(c: str, w, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def features(df: DataFrame, keys="symbol", order="date", price="close", volume="volume",
             sentiment: str | None = "avg_sentiment", drop_incomplete: bool = True,
             passes: int = 1, block_rows: int | None = None, median: str = "exact") -> DataFrame:
    """Return, 7-row volatility, Amihud illiquidity, 30-row turnover, sentiment lags,
    volatility regime against the per-symbol median; then drop incomplete rows (P4).

    ``median="sketch"`` takes the median from a mergeable quantile sketch (:func:`sketched_median`): no task holds a
    symbol's values.

    ``passes=2`` reproduces the original main flow, which applies the bundle twice.
    ``block_rows`` switches to blocked windows for very long series (see
    :func:`blocked_apply`); results are identical."""
    keys, order = _list(keys), _list(order)
    out = df
    for _ in range(max(1, passes)):
        if block_rows:
            out = _features_blocked(out, keys, order, price, volume, sentiment, drop_incomplete, block_rows, median)
        else:
            out = _features_once(out, keys, order, price, volume, sentiment, drop_incomplete, median)
    return out


_FEATURE_COLS = ("return", "volatility_7d", "illiquidity", "turnover_ratio", "market_regime",
                 *[f"sentiment_lag_{k}" for k in config.SENTIMENT_LAGS])


def _window_features(df, part_keys, order, price, volume, sentiment):
    """The window-local part of W9 (everything except the per-symbol median)."""
    w = _w(part_keys, order)
    base = [c for c in df.columns if c not in _FEATURE_COLS]
    step1 = df.select(*base, simple_return(price, w).alias("return"))
    lags = []
    if sentiment and sentiment in df.columns:
        lags = [F.lag(sentiment, k).over(w).alias(f"sentiment_lag_{k}") for k in config.SENTIMENT_LAGS]
    return step1.select(
        "*",
        rolling_std("return", w, config.VOL_WINDOW).alias("volatility_7d"),
        safe_ratio(F.abs(F.col("return")), F.col(volume)).alias("illiquidity"),
        safe_ratio(F.col(volume), rolling_mean(volume, w, config.TURNOVER_WINDOW)).alias("turnover_ratio"),
        *lags,
    )


def _regime(vol: Column, med: Column) -> Column:
    return F.when(vol > med, F.lit("High Volatility")).otherwise(F.lit("Low Volatility"))


#: Size of the quantile sketch: ranks are off by 1.33 % of the rows at most, with 99 % confidence, whatever their number.
SKETCH_K, RANK_ERROR = 200, 0.0133


def sketched_median(df: DataFrame, value: str, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """A7 at scale: ``keys, _med, _med_rows``: a value whose rank is within ``RANK_ERROR`` (for the default ``k``) of the
    middle. Tasks send a sketch of bounded size per key on; sketches merge."""
    sketch = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("_kll"))
    return sketch.select(*keys, F.kll_sketch_get_quantile_double("_kll", F.lit(0.5)).alias("_med"), F.kll_sketch_get_n_double("_kll").alias("_med_rows"))


def _with_regime(df, medians, keys):
    """Each row's regime by its key's median; NULL keys are a key. One row a key: AQE broadcasts it from its measured size."""
    renamed = medians.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "_med")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    out = df.join(renamed, same, "left").withColumn("market_regime", _regime(F.col("volatility_7d"), F.col("_med")))
    return out.drop("_med", *(f"_k{i}" for i in range(len(keys))))


def _features_blocked(df, keys, order, price, volume, sentiment, drop_incomplete, block_rows, median="exact"):
    from murmur.operators.ordering import exact_quantiles
    win = blocked_apply(df, keys, order[0],
                        lambda d, pk: _window_features(d, pk, order, price, volume, sentiment), block_rows)
    # the windows are computed once; the median and the rows both read the stored result
    ensure_checkpoint_dir(df.sparkSession)
    win = win.checkpoint(eager=True)
    if median == "sketch":
        med = sketched_median(win, "volatility_7d", keys)
    else:
        med = exact_quantiles(win, "volatility_7d", [0.5], keys).select(*keys, F.col("value").alias("_med"))
    out = _with_regime(win, med, keys)
    return out.na.drop("any") if drop_incomplete else out


def blocked_apply(df: DataFrame, keys: list[str], order: str, fn, block_rows: int,
                  halo: int = 48, index_col: str | None = None) -> DataFrame:
    """Run window computations over very long series without one task per series.

    Each row gets its index inside its series from the range-partitioned prefix sum (no
    per-series task), series are cut into blocks of ``block_rows``, each block also
    receives a copy of the previous block's last ``halo`` rows, ``fn(frame, partition_keys)``
    computes its windows partitioned by (keys, block), and the halo copies are dropped.
    Exact as long as every look-back chain is shorter than ``halo`` (here at most
    40 + 1 + 6 = 47 rows: Kalman horizon, return, 7-row volatility)."""
    from murmur.operators.ordering import range_prefix
    if block_rows < halo:
        raise ValueError(f"block_rows must be at least the halo of {halo} rows: only the block before lends rows")
    idx_col = index_col or "_idx"
    idx = range_prefix(df, [order], keys, None, idx_col).drop("_group_total")
    blk = F.floor(F.col(idx_col) / block_rows)
    idx = idx.withColumn("_blk", blk)
    tail = (idx.where(F.col(idx_col) % block_rows >= block_rows - halo)
            .withColumn("_blk", F.col("_blk") + 1).withColumn("_halo", F.lit(True)))
    both = idx.withColumn("_halo", F.lit(False)).unionByName(tail)
    out = fn(both, keys + ["_blk"])
    out = out.where(~F.col("_halo")).drop("_halo", "_blk")
    return out if index_col else out.drop(idx_col)


def _features_once(df, keys, order, price, volume, sentiment, drop_incomplete, median="exact"):
    step2 = _window_features(df, keys, order, price, volume, sentiment)
    if median == "sketch":
        step3 = _with_regime(step2, sketched_median(step2, "volatility_7d", keys), keys)
        return step3.na.drop("any") if drop_incomplete else step3
    # A7 + W6: exact median per symbol over the same window partitioning (no new exchange).
    med = F.median("volatility_7d").over(Window.partitionBy(*keys))
    step3 = step2.withColumn("market_regime", _regime(F.col("volatility_7d"), med))
    return step3.na.drop("any") if drop_incomplete else step3


def _kalman_weight(i: Column, t: Column) -> Column:
    """Weight of observation i in the filtered mean at t (local-level model, unit noises,
    initial mean = first observation): F(2i+2)/F(2t+3), and 2/F(2t+3) for i = 0,
    written with Binet's formula so it never overflows."""
    denom = F.lit(1.0) - F.pow(F.lit(_R), (2 * t + 3).cast("double"))
    first = F.lit(2.0 * math.sqrt(5.0)) * F.pow(F.lit(PHI), (-(2 * t + 3)).cast("double")) / denom
    other = (F.pow(F.lit(PHI), (2 * (i - t) - 1).cast("double"))
             * (F.lit(1.0) - F.pow(F.lit(_R), (2 * i + 2).cast("double"))) / denom)
    return F.when(i == 0, first).otherwise(other)


def kalman_filter(df: DataFrame, keys="symbol", order="date", value="close",
                  out="kalman_close", horizon: int = KALMAN_HORIZON, index_col: str | None = None) -> DataFrame:
    """Filtered state mean of a 1-D local-level Kalman filter as a bounded FIR window.

    The gains of this model do not depend on the data (1/2, 3/5, 8/13, ... -> 0.618), so the
    filtered mean is a fixed weighted sum of past observations whose weights decay by
    phi^-2 per row; ``horizon`` rows reproduce the recursion to double precision."""
    keys, order = _list(keys), _list(order)
    w = _w(keys, order)
    # FIR start-up weights need the row's index in the whole series (given in blocked mode)
    t = (F.col(index_col) if index_col else F.row_number().over(w) - 1).alias("_t")
    win = F.collect_list(value).over(w.rowsBetween(-horizon, 0)).alias("_win")
    staged = df.select("*", t, win)
    n = F.size("_win")
    tt = F.col("_t")
    fir = F.aggregate(
        F.transform("_win", lambda z, j: z * _kalman_weight(tt - n + 1 + j, tt)),
        F.lit(0.0), lambda a, b: a + b)
    return staged.withColumn(out, fir).drop("_t", "_win")


def kalman_features(df: DataFrame, keys="symbol", order="date", value="close",
                    block_rows: int | None = None) -> DataFrame:
    """W7+W8: Kalman close, its simple return and 7-row volatility (one window partitioning).
    ``block_rows`` runs it as blocked windows for very long series (identical results)."""
    keys, order = _list(keys), _list(order)

    def run(d, part_keys, index_col=None):
        w = _w(part_keys, order)
        k = kalman_filter(d, part_keys, order, value, index_col=index_col)
        k = k.withColumn("kalman_return", simple_return("kalman_close", w))
        return k.withColumn("kalman_volatility", rolling_std("kalman_return", w, config.VOL_WINDOW))

    if block_rows:
        out = blocked_apply(df, keys, order[0], lambda d, pk: run(d, pk, "_gidx"), block_rows,
                            index_col="_gidx")
        return out.drop("_gidx")
    return run(df, keys)


def chronological_split(df: DataFrame, keys="symbol", order="date",
                        test_fraction: float = config.TEST_FRACTION, ranged: bool = False) -> DataFrame:
    """Per series, the last ceil(f*n) rows are test rows (``is_test``); no shuffle of rows
    across series, exact unlike ``randomSplit``. ``ranged`` numbers the rows by range partitions, for series that are no
    single task's work; ``keys`` + ``order`` should then be unique."""
    keys, order = _list(keys), _list(order)
    n_test = lambda n: F.ceil(n * F.lit(test_fraction))  # noqa: E731 - same double arithmetic as the original split
    if ranged:
        from murmur.operators.ordering import range_prefix
        n = F.col("_group_total")
        return (range_prefix(df, order, keys, None, "_before").withColumn("is_test", F.col("_before") >= n - n_test(n))
                .drop("_before", "_group_total"))
    w = _w(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("is_test", F.row_number().over(w) > n - n_test(n))


def lag_points(features_df: DataFrame, x: str = "sentiment_lag_1", y: str = "illiquidity") -> DataFrame:
    """The lagged-sentiment vs illiquidity point set."""
    return features_df.select(*[c for c in ("symbol", "date") if c in features_df.columns], x, y)
