"""From raw documents to sharded training data, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet into the shared
folder and reads it back as the next stage's documents. All but the last return the columns of ``documents``.
The quality and mixing stages rest on fitted models, so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import decontaminate, mixing, quality, sharding, simhash
from murmur.llm.common import pinned, table

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = pinned(function(spark, docs, sf_dir), f"stage-{name}")
    return docs
