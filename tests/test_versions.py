"""Versioned tables and the stream that publishes them."""

import json

import pytest
from pyspark.sql import functions as F

from murmur.sources import files, versions
from murmur.streaming import incremental


def letters(dies_at=None):
    """A factory that travels by value: workers don't know this module."""
    def factory():
        def score(texts):
            if dies_at in texts:
                raise ValueError("model died")
            return [{"label": t[:1] or "-", "score": len(t) / 8} for t in texts]
        return score
    return factory


def put(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, at, state="state", **kw):
    return incremental.incremental_irony(spark, f"{at}/in", f"{at}/out", f"{at}/{state}", ["doc_id"], factory=letters(), **kw)


def rows(df):
    return sorted(((r["doc_id"], r["sarcasm_label"]) for r in df.collect()), key=repr)


def test_an_item_that_comes_again_keeps_its_first_score_over_restarts(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, "a"), (2, "b"), (None, "n"), (None, "n")])
    run(spark, tmp_path, remember="7 days")
    put(spark, f"{tmp_path}/in", [(1, "changed"), (3, "c"), (None, "m")])
    put(spark, f"{tmp_path}/in", [(3, "c"), (4, "d")])
    got = run(spark, tmp_path, remember="7 days", max_files_per_trigger=1)
    assert rows(got) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "m"), (None, "n"), (None, "n")]
    assert versions.versions(spark, f"{tmp_path}/out") == [1, 2]
    run(spark, tmp_path, remember="7 days")  # nothing new: no new version
    assert versions.versions(spark, f"{tmp_path}/out") == [1, 2]


def test_a_run_that_dies_publishes_nothing_and_goes_on(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, "a")])
    run(spark, tmp_path)
    put(spark, f"{tmp_path}/in", [(2, "b")])
    put(spark, f"{tmp_path}/in", [(3, "x")])
    before = versions.read(spark, f"{tmp_path}/out")

    with pytest.raises(Exception, match="model died"):
        incremental.incremental_irony(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", ["doc_id"], factory=letters("x"), max_files_per_trigger=1)
    assert rows(versions.read(spark, f"{tmp_path}/out")) == rows(before) == [(1, "a")]
    assert rows(run(spark, tmp_path)) == [(1, "a"), (2, "b"), (3, "x")]
    assert rows(before) == [(1, "a")]  # a reader of the old version still sees it whole


def test_a_lost_checkpoint_replaces_the_table_whole(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, "a")])
    put(spark, f"{tmp_path}/in", [(2, "b")])
    run(spark, tmp_path, max_files_per_trigger=1)
    put(spark, f"{tmp_path}/in", [(3, "c")])
    assert rows(run(spark, tmp_path, state="another")) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(versions.read(spark, f"{tmp_path}/out", 1)) == [(1, "a"), (2, "b")]
    assert versions.expire(spark, f"{tmp_path}/out", keep=1) == [1] and rows(versions.read(spark, f"{tmp_path}/out")) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError, match="no version 1"):
        versions.read(spark, f"{tmp_path}/out", 1)


def test_a_folder_without_files_gives_a_table_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    got = run(spark, tmp_path, schema=schema)
    assert got.columns == ["doc_id", "sarcasm_label", "sarcasm_score"] and got.count() == 0
    put(spark, f"{tmp_path}/in", [(1, "a")])
    assert rows(run(spark, tmp_path)) == [(1, "a")]


def test_of_two_writers_of_one_number_one_takes_the_next(spark, tmp_path):
    schema = spark.range(1).schema
    root = str(tmp_path)
    for name in ("x", "y"):
        spark.range(3 if name == "x" else 5).write.parquet(f"{root}/{name}")
    assert versions.publish(spark, root, ["x"], schema) == 1
    assert not files.write_text(spark, f"{root}/_versions/0000000001.json", json.dumps({"folders": []}), replace=False)
    assert versions.publish(spark, root, ["y"], schema) == 2 and versions.publish(spark, root, ["y"], schema) == 2
    assert [versions.read(spark, root, v).agg(F.count("*")).first()[0] for v in (1, 2)] == [3, 5]
    assert versions.publish(spark, root, [], schema) == 3 and versions.read(spark, root).count() == 0
