"""Feature bundle (W1-W6, W9, A7) against a plain-Python brute force, one and two passes."""

import math
import statistics

import numpy as np
import pytest

from murmur.operators import timeseries as ts


def _brute_once(rows):
    """rows: list of dicts sorted by date for one symbol -> feature rows with nulls dropped."""
    n = len(rows)
    c = [r["close"] for r in rows]
    v = [r["volume"] for r in rows]
    ret = [None] + [c[i] / c[i - 1] - 1 if c[i - 1] else None for i in range(1, n)]
    vol = [None] * n
    turn = [None] * n
    for i in range(n):
        win = ret[max(0, i - 6): i + 1]
        if len(win) == 7 and all(x is not None for x in win):
            vol[i] = statistics.stdev(win)
        vw = v[max(0, i - 29): i + 1]
        if len(vw) == 30:
            m = sum(vw) / 30
            turn[i] = v[i] / m if m else None
    present = sorted(x for x in vol if x is not None)
    med = statistics.median(present) if present else None
    out = []
    for i in range(n):
        ill = abs(ret[i]) / v[i] if ret[i] is not None and v[i] else None
        lag1 = rows[i - 1]["avg_sentiment"] if i >= 1 else None
        lag2 = rows[i - 2]["avg_sentiment"] if i >= 2 else None
        regime = "High Volatility" if (vol[i] is not None and med is not None and vol[i] > med) else "Low Volatility"
        rec = dict(rows[i], **{"return": ret[i], "volatility_7d": vol[i], "illiquidity": ill,
                               "turnover_ratio": turn[i], "sentiment_lag_1": lag1, "sentiment_lag_2": lag2,
                               "market_regime": regime})
        if all(x is not None for x in rec.values()):
            out.append(rec)
    return out


@pytest.mark.parametrize("passes", [1, 2])
def test_features_match_bruteforce(spark, passes):
    rng = np.random.default_rng(passes)
    data = []
    for s, n in (("A", 120), ("B", 75), ("C", 31)):
        close = 50 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            data.append({"symbol": s, "date": i, "close": float(close[i]),
                         "volume": float(rng.integers(0, 40)), "avg_sentiment": float(rng.normal())})
    df = spark.createDataFrame(data, "symbol string, date int, close double, volume double, avg_sentiment double")
    got = ts.features(df, passes=passes).collect()
    expect = []
    for s in ("A", "B", "C"):
        rows = [r for r in data if r["symbol"] == s]
        for _ in range(passes):
            rows = [{k: r[k] for k in ("symbol", "date", "close", "volume", "avg_sentiment")} for r in _brute_once(rows)]
        expect += [(r["symbol"], r["date"]) for r in rows]
    assert sorted((r["symbol"], r["date"]) for r in got) == sorted(expect)
    # values on the last pass
    last = {}
    for s in ("A", "B", "C"):
        rows = [r for r in data if r["symbol"] == s]
        for p in range(passes):
            full = _brute_once(rows)
            rows = [{k: r[k] for k in ("symbol", "date", "close", "volume", "avg_sentiment")} for r in full]
        last.update({(r["symbol"], r["date"]): r for r in full})
    for r in got:
        e = last[(r["symbol"], r["date"])]
        for k in ("return", "volatility_7d", "illiquidity", "turnover_ratio", "sentiment_lag_1", "sentiment_lag_2"):
            assert math.isclose(r[k], e[k], rel_tol=1e-9, abs_tol=1e-12), (k, r[k], e[k])
        assert r["market_regime"] == e["market_regime"]


def test_lexicon_scores_match_bruteforce(spark):
    import re
    import random as _r

    from murmur import config
    from murmur.operators import lexicon as lex

    rnd = _r.Random(21)
    entries = [("good", 1.9), ("bad", -2.5), ("hot", 1.5), ("cold", -1.3), ("ring", 0.2)]
    words = [w for w, _ in entries] + ["not", "never", "the", "x", "ring", "cannot"]
    texts = []
    for i in range(300):
        n = rnd.randint(0, 12)
        sep = lambda: rnd.choice([" ", ", ", "-", "\n", "  "])
        t = "".join(rnd.choice(words).upper() if rnd.random() < 0.2 else rnd.choice(words) + sep() for _ in range(n))
        texts.append((i, t if rnd.random() > 0.05 else None))
    df = spark.createDataFrame(texts, "item_id long, text string")
    lx = spark.createDataFrame(entries, lex.LEXICON_SCHEMA)
    got = {r["item_id"]: (r["vader"], r["textblob"]) for r in lex.score_items(df, lx).collect()}
    val = dict(entries)
    for i, t in texts:
        toks = re.findall("[a-z]+", (t or "").lower())
        s, pol = 0.0, []
        for p, tok in enumerate(toks):
            if tok not in val:
                continue
            neg = any(x in config.NEGATORS for x in toks[max(0, p - config.NEGATION_LOOKBACK):p])
            s += val[tok] * (config.NEGATION_SCALAR if neg else 1.0)
            pol.append(val[tok] / config.POLARITY_SCALE * (config.POLARITY_NEGATION if neg else 1.0))
        v = s / math.sqrt(s * s + config.COMPOUND_ALPHA) if pol else 0.0
        p = sum(pol) / len(pol) if pol else 0.0
        assert math.isclose(got[i][0], v, abs_tol=1e-12) and math.isclose(got[i][1], p, abs_tol=1e-12), (t, got[i], v, p)


def test_regression_metrics_match_numpy(spark):
    from murmur.operators import stats
    rng = np.random.default_rng(3)
    y = rng.normal(size=39) * 1e-10
    rows, expect = [], {}
    for m, noise in (("a", 0.5), ("b", 2.0)):
        p = y + rng.normal(size=39) * noise * 1e-10
        rows += [(m, float(a), float(b)) for a, b in zip(y, p)]
        e = y - p
        expect[m] = (np.mean(np.abs(e)), np.sqrt(np.mean(e * e)), 1 - np.sum(e * e) / np.sum((y - y.mean()) ** 2))
    df = spark.createDataFrame(rows, "model string, actual double, prediction double")
    for r in stats.regression_metrics(df, group_cols=["model"]).collect():
        mae, rmse, r2 = expect[r["model"]]
        assert math.isclose(r["mae"], mae, rel_tol=1e-12) and math.isclose(r["rmse"], rmse, rel_tol=1e-12)
        assert math.isclose(r["r2"], r2, rel_tol=1e-9)
