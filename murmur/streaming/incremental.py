"""Scoring of newly arrived text files, each item once, with atomic replacement of the result.

The original processes a large CSV in bounded chunks, appends each scored chunk to a
temporary file and swaps it in at the end. Here the file source lists new files and
``maxFilesPerTrigger`` bounds each micro-batch; the checkpoint records which files are done and, in a state store, which
items were seen, so a restart goes on and an item that is delivered again is not scored again; a micro-batch writes its own
folder, which a replay overwrites; and only when the backlog is done are the folders of this query published as
the new version of the result (:mod:`murmur.sources.versions`). A query that lost its checkpoint is a new query with new
folders: it scores the source anew, and its version replaces the old one whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from murmur.operators.scoring import ScorerFactory, irony_scores, rescored
from murmur.sources import files, versions


def first_seen(stream: DataFrame, key_cols: list[str], remember: str) -> DataFrame:
    """The first row of each key tuple; one that comes again within ``remember`` is dropped. Arrival time is the event
    time: no row is late, whatever its own date, and the state holds what arrived within that time only. Rows with a
    NULL key are all kept. Of rows of one key in one micro-batch any one stays: order them by files if they differ."""
    own = F.when(F.coalesce(*(F.when(F.col(k).isNull(), True) for k in key_cols), F.lit(False)), F.uuid())
    seen = stream.withColumns({"_arrived": F.current_timestamp(), "_own": own}).withWatermark("_arrived", remember)
    return seen.dropDuplicatesWithinWatermark([*key_cols, "_own"]).drop("_arrived", "_own")


def score_new_files(spark: SparkSession, source_dir: str, sink_path: str, checkpoint_path: str, key_cols: list[str],
                    score: Callable[[DataFrame], DataFrame], path_glob: str = "*.parquet", schema: T.StructType | None = None,
                    max_files_per_trigger: int = 32, remember: str | None = None) -> DataFrame:
    """Score the items of all files not seen yet and publish; returns the published table. With ``remember`` an item that was
    seen within that time is not scored again (:func:`first_seen`), without it every row of every file is. ``schema`` is
    needed only for a folder that holds no file so far: it gives a table without rows."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", path_glob).parquet(source_dir).schema
    missing = [c for c in key_cols if c not in schema.names]
    if missing:
        raise ValueError(f"{source_dir} has no column {missing}")
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", path_glob)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    if remember:
        stream = first_seen(stream, key_cols, remember)

    def query_id() -> str:
        return json.loads(files.read_text(spark, f"{checkpoint_path}/metadata"))["id"]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        files.write_table(score(batch), f"{sink_path}/{query_id()}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    done = [n for n in files.names_in(spark, f"{sink_path}/{query_id()}") if n.startswith("batch=")]
    done.sort(key=lambda n: int(n.partition("=")[2]))
    out = score(spark.createDataFrame([], schema)).schema
    versions.publish(spark, sink_path, [f"{query_id()}/{n}" for n in done], out, query=query_id())
    return versions.read(spark, sink_path)


def incremental_irony(spark: SparkSession, source_dir: str, sink_path: str, checkpoint_path: str,
                      key_cols: list[str], text_col: str = "text", path_glob: str = "*.parquet",
                      factory: ScorerFactory | None = None, max_files_per_trigger: int = 32,
                      schema: T.StructType | None = None, remember: str | None = None) -> DataFrame:
    """``(keys, sarcasm_label, sarcasm_score)`` of every item under ``source_dir``, newly arrived ones added."""
    return score_new_files(spark, source_dir, sink_path, checkpoint_path, key_cols,
                           lambda batch: irony_scores(batch, key_cols, text_col, factory),
                           path_glob, schema, max_files_per_trigger, remember)


def rescore_items(spark: SparkSession, source_dir: str, sink_path: str, checkpoint_path: str,
                  key_cols: list[str], text_col: str = "text", path_glob: str = "*.parquet",
                  model: ScorerFactory | None = None, irony: ScorerFactory | None = None,
                  max_files_per_trigger: int = 32, schema: T.StructType | None = None, remember: str | None = None) -> DataFrame:
    """Incremental row-level re-scoring (model score + irony label/score) of new files; rows keep all their columns."""
    if model is None and irony is None:
        raise ValueError("rescoring needs a model or an irony model")
    return score_new_files(spark, source_dir, sink_path, checkpoint_path, key_cols,
                           lambda batch: rescored(batch, text_col, model, irony),
                           path_glob, schema, max_files_per_trigger, remember)
