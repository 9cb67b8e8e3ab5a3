"""The pipeline's mixing stage on null, repeated and odd rows."""

import random

from pyspark.sql import functions as F

from murmur.llm import mixing


def test_rows_without_an_id_are_drawn_apart(spark, tmp_path):
    r = random.Random(4)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    text = lambda words: " ".join(r.choice(words) for _ in range(60))
    rows = [(i, text(good if i % 2 else bad), "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    clean = [(None, text(good), "en", "s", 1) for _ in range(100)]
    toxic = [(None, text(bad), "en", "s", 1) for _ in range(100)] + [(1, text(bad), "en", "s", 1)] * 3
    odd = [(None, None, None, None, None), (900, "", "en", None, 0), (901, None, "fr", "s", 5)]
    docs = spark.createDataFrame(rows + clean + toxic + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kind = F.when(F.col("text").startswith("g"), "good").when(F.col("text").startswith("b"), "bad").otherwise("odd")
    kept = {(x["null_id"], x["kind"]): x["count"] for x in got.groupBy(F.col("doc_id").isNull().alias("null_id"), kind.alias("kind")).count().collect()}
    assert kept[True, "good"] >= 90 and kept.get((True, "bad"), 0) <= 40  # neither all nor none by one draw
    assert got.where("doc_id = 1 AND text LIKE 'b%'").count() in (0, 3) and got.where("doc_id = 1 AND text LIKE 'g%'").count() == 1
    assert mixing.stage(spark, docs.where("false"), str(tmp_path)).count() == 0
