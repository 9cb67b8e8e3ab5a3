"""C1 end to end on the sf0.001 tables (small model settings keep it quick)."""

import pytest
from pyspark.sql import functions as F

from murmur.config import RunOptions
from murmur.operators import lexicon as lex, ml
from murmur.plans import pipelines
from murmur.sources import tables as tb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    li, orders, part = (tb.load(spark, SF, t) for t in ("lineitem", "orders", "part"))
    return pipelines.Inputs(posts=tb.posts_from_orders(orders), comments=tb.comments_from_lineitem(li, part),
                            bars=tb.bars_from_lineitem(li), lexicon=lex.lexicon_frame(spark))


def test_full_pipeline_artifacts(spark, inputs, monkeypatch):
    monkeypatch.setattr(ml.config, "RF_TREES", 5)
    out = pipelines.full(inputs, run_models=False)
    assert out["orphans"].count() == 0
    counters = {r["stage"]: r["rows"] for r in out["quality_counters"].collect()}
    assert counters == {"posts_after_dedup": 1500, "comments_after_dedup": 6000, "orphan_comments": 0}
    assert out["posts_enriched"].count() == tb.load(spark, SF, "orders").count()
    feats = out["features"]
    assert feats.count() > 0 and feats.where(F.col("finbert_sentiment") != 0).count() == 0
    k = {r["comparison"]: r for r in out["kappa"].collect()}
    assert set(k) == {"vader vs textblob", "vader vs finbert", "textblob vs finbert"}
    assert all(r["sample_size"] == 7500 for r in k.values())
    assert out["sarcasm"].where(F.col("sarcasm_label") != "UNKNOWN").count() == 0
    assert out["reliability"].count() == 7500


def test_parity_options_apply_features_twice(spark, inputs):
    one = pipelines.full(inputs, run_models=False)["features"].count()
    two = pipelines.full(pipelines.Inputs(**{**inputs.__dict__, "options": RunOptions(parity=True)}),
                         run_models=False)["features"].count()
    assert two < one


def test_rescore_daily_replaces_column(spark, inputs):
    out = pipelines.full(inputs, run_models=False)

    def factory():
        return lambda texts: [{"positive": 0.75, "negative": 0.25} for _ in texts]

    res = pipelines.rescore_daily(out["merged"], out["items"], factory)
    vals = {r["finbert_sentiment"] for r in res["merged"].select("finbert_sentiment").distinct().collect()}
    assert vals == {0.5}
    line = res["summary"].first()
    assert (line["scorer"], line["count"], line["non_zero"], line["mean"], line["q50"]) == ("finbert_sentiment", res["merged"].count(), line["count"], 0.5, 0.5)


def test_rescoring_from_raw_files_drops_missing_texts_and_keeps_repeated_ones(spark):
    posts = spark.createDataFrame([("p", 0.0, "t"), ("p", 0.0, "t"), ("q", None, "u"), ("r", 86400.0, None)], "id string, created_utc double, title string")
    comments = spark.createDataFrame([("c", 0.0, "hi"), (None, 0.0, "hi")], "id string, created_utc double, body string")
    items = pipelines.raw_daily_items(comments, posts)
    from murmur.operators import textchunks
    assert [tuple(r) for r in textchunks.daily_chunks(items).select("chunk", "text").collect()] == [(0, "hi hi t t")]


def test_cli_demo_run(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    res = subprocess.run([sys.executable, "-m", "murmur", "--demo-sf", SF, "--out", str(tmp_path), "--no-models",
                          "--master", "local[2]"], cwd=root, capture_output=True, text=True, timeout=900)
    assert res.returncode == 0, res.stderr[-3000:]
    written = set(os.listdir(tmp_path))
    assert {"features", "kappa", "daily_social", "posts_enriched", "daily_market", "sarcasm"} <= written
    assert os.path.exists(tmp_path / "features" / "_SUCCESS")


def test_cli_on_raw_csv_inputs(tmp_path):
    import os
    import subprocess
    import sys

    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    days = pd.date_range("2024-01-01", periods=80, freq="D")
    epoch = [int(d.timestamp()) + 3600 for d in days]
    posts = pd.DataFrame({"id": [f"p{i}" for i in range(80)], "author": "a",
                          "title": [f"Tesla earnings day {i}\nsecond line" for i in range(80)],
                          "created_utc": epoch, "score": rng.integers(0, 100, 80)})
    comments = pd.DataFrame({"id": [f"c{i}" for i in range(160)], "author": "b",
                             "body": ["good stock, not bad" if i % 2 else "bad price" for i in range(160)],
                             "created_utc": [epoch[i // 2] + 60 for i in range(160)], "score": 1,
                             "link_id": [f"t3_p{i // 2}" for i in range(160)]})
    close = 100 + np.cumsum(rng.normal(0, 1, 80))
    bars = pd.DataFrame({"Date": [d.strftime("%Y-%m-%d") for d in days], "Close": close, "High": close + 1,
                         "Low": close - 1, "Open": close, "Volume": rng.integers(1_000, 5_000, 80)})
    posts.to_csv(tmp_path / "posts.csv", index=False)
    comments.to_csv(tmp_path / "comments.csv", index=False)
    bars.to_csv(tmp_path / "bars.csv", index=False)
    (tmp_path / "lex.tsv").write_text("good\t1.9\nbad\t-2.5\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tmp_path / "out"
    res = subprocess.run([sys.executable, "-m", "murmur", "--posts", str(tmp_path / "posts.csv"),
                          "--comments", str(tmp_path / "comments.csv"), "--bars", str(tmp_path / "bars.csv"),
                          "--lexicon", str(tmp_path / "lex.tsv"), "--symbol", "TSLA", "--out", str(out),
                          "--no-models", "--format", "csv", "--master", "local[2]"],
                         cwd=root, capture_output=True, text=True, timeout=900)
    assert res.returncode == 0, res.stderr[-3000:]
    feats = pd.concat(pd.read_csv(f) for f in (out / "features").glob("part-*.csv"))
    assert len(feats) == 80 - 29  # the 30-row turnover window is the last to fill
    counters = pd.concat(pd.read_csv(f) for f in (out / "quality_counters").glob("part-*.csv"))
    assert dict(zip(counters["stage"], counters["rows"])) == {
        "posts_after_dedup": 80, "comments_after_dedup": 160, "orphan_comments": 0}
