"""The artifact graph: order, each source parsed once, resumption after a failure, equal artifacts."""

import glob
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from murmur.operators import lexicon as lex
from murmur.plans import pipelines
from murmur.plans.artifacts import ArtifactGraph, Step
from murmur.sources import files, tables as tb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def chain(spark, log, broken=()):
    def step(name, build):
        def logged(*frames):
            log.append(name)
            if name in broken:
                raise RuntimeError(f"{name} died")
            return build(*frames)
        return logged

    a, b, c, d = (step("a", lambda: spark.range(5)), step("b", lambda a: a.withColumn("x", F.col("id") * 2)),
                  step("c", lambda a, b: a.join(b, "id")), step("d", lambda a: a.where("id > 2")))
    return ArtifactGraph([Step("d", lambda a: d(a)), Step("c", lambda a, b: c(a, b)), Step("b", lambda a: b(a)), Step("a", lambda: a())])


def test_steps_run_after_what_they_need_and_only_for_the_targets(spark, tmp_path):
    log = []
    graph = chain(spark, log)
    assert [s.name for s in graph.order()] == ["a", "d", "b", "c"] and [s.name for s in graph.order(["b"])] == ["a", "b"]
    out = graph.materialise(spark, str(tmp_path), "s", ["c"])
    assert log == ["a", "b", "c"] and out["c"].count() == 5 and sorted(os.listdir(tmp_path)) == ["_markers", "a", "b", "c"]
    with pytest.raises(ValueError, match="need each other"):
        ArtifactGraph([Step("x", lambda y: y), Step("y", lambda x: x)]).order()
    with pytest.raises(ValueError, match="no step z, needed by x"):
        ArtifactGraph([Step("x", lambda z: z)]).order()


def test_a_run_that_died_goes_on_and_a_new_stamp_starts_anew(spark, tmp_path):
    log = []
    with pytest.raises(RuntimeError, match="c died"):
        chain(spark, log, broken=("c",)).materialise(spark, str(tmp_path), "s")
    written = {}
    log.clear()
    chain(spark, log).materialise(spark, str(tmp_path), "s", report=written.__setitem__)
    assert log == ["c"] and written == {"a": False, "d": False, "b": False, "c": True}
    log.clear()
    files.delete(spark, f"{tmp_path}/_markers/b.json")  # as if killed while b was written: b and what needs it
    chain(spark, log).materialise(spark, str(tmp_path), "s")
    assert log == ["b", "c"]
    log.clear()
    chain(spark, log).materialise(spark, str(tmp_path), "other inputs")
    assert log == ["a", "d", "b", "c"]


def test_stored_artifacts_equal_the_lazy_ones(spark, tmp_path):
    li, orders, part = (tb.load(spark, SF, t) for t in ("lineitem", "orders", "part"))

    def model():
        return lambda texts: [{"positive": t.count("e") / 99, "negative": t.count("o") / 99, "label": "X" if "a" in t else "Y", "score": len(t) / 999} for t in texts]

    inputs = pipelines.Inputs(posts=tb.posts_from_orders(orders), comments=tb.comments_from_lineitem(li, part), bars=tb.bars_from_lineitem(li),
                              lexicon=lex.lexicon_frame(spark), item_model=model, irony_model=model, day_model=model)
    graph = pipelines.graph(inputs, run_models=False)
    targets = ["kappa", "scorer_boxes", "scorer_scatter", "sarcasm", "features", "volume_outliers", "orphans"]
    lazy, stored = graph.lazy(targets), graph.materialise(spark, str(tmp_path), "s", targets)

    def rows(df):
        flat = [tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect()]
        return sorted(flat, key=repr)

    for name in targets:
        assert stored[name].columns == lazy[name].columns and rows(stored[name]) == rows(lazy[name]), name


def csvs(folder):
    import pandas as pd

    days = pd.date_range("2024-01-01", periods=50, freq="D")
    at = [int(d.timestamp()) for d in days]
    pd.DataFrame({"id": [f"p{i}" for i in range(50)], "author": "a", "title": "Tesla\nprice", "created_utc": at, "score": 1}).to_csv(f"{folder}/posts.csv", index=False)
    pd.DataFrame({"id": [f"c{i}" for i in range(50)], "author": "b", "body": "good, not bad", "created_utc": at, "score": [*range(49), "x"],
                  "link_id": [f"t3_p{i}" for i in range(50)]}).to_csv(f"{folder}/comments.csv", index=False)
    pd.DataFrame({"Date": days.strftime("%Y-%m-%d"), "Close": range(1, 51), "High": 2, "Low": 1, "Open": 1, "Volume": 10}).to_csv(f"{folder}/bars.csv", index=False)
    os.makedirs(f"{folder}/conf")
    os.makedirs(f"{folder}/events")
    with open(f"{folder}/conf/spark-defaults.conf", "w") as f:
        f.write(f"spark.eventLog.enabled true\nspark.eventLog.dir file://{folder}/events\nspark.eventLog.compress false\nspark.eventLog.rolling.enabled false\n")


def run(folder):
    return subprocess.run([sys.executable, "-m", "murmur", "--posts", f"{folder}/posts.csv", "--comments", f"{folder}/comments.csv", "--bars", f"{folder}/bars.csv",
                           "--out", f"{folder}/out", "--no-models", "--master", "local[4]"], cwd=ROOT, capture_output=True, text=True, timeout=900,
                          env=os.environ | {"SPARK_CONF_DIR": f"{folder}/conf"})


def test_the_command_parses_each_csv_once_and_keeps_what_is_there(tmp_path):
    csvs(tmp_path)
    first = run(tmp_path)
    assert first.returncode == 0, first.stderr[-3000:]
    scans = 0
    for log in glob.glob(f"{tmp_path}/events/*"):
        for line in open(log):
            event = json.loads(line)
            if event["Event"].endswith("SparkListenerSQLExecutionStart"):
                scans += event["physicalPlanDescription"].count("Scan csv ") > 0
    assert scans == 3
    import pandas as pd

    counts = pd.read_parquet(f"{tmp_path}/out/ingest_counts").set_index(["source", "reason"])["rows"]
    assert counts["comments", "rows"] == 50 and counts["comments", "bad_score"] == 1 and counts["bars", "malformed"] == 0
    assert len(pd.read_parquet(f"{tmp_path}/out/quarantine")) == 1
    os.remove(f"{tmp_path}/out/_markers/kappa.json")
    again = run(tmp_path)
    assert again.returncode == 0, again.stderr[-3000:]
    assert [x for x in again.stdout.split("\n") if x.startswith("wrote")] == ["wrote kappa"] and "kept features" in again.stdout
