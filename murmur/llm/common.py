"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that stand in a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased; all others become a space.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and everything beyond ASCII (UTF-8 bytes)."""
    return text.translate(PLAIN_WORDS).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at exactly these six bytes."""
    return text.split() if text else []


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="murmur-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: lineage ends there,
    and lost executors cost no recomputation."""
    path = f"{scratch(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: the lambda's variable holds it.
    (Catalyst may otherwise copy the expression into a lambda and run it for each element.)"""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each key of ``rows``, null keys equal; ``size`` says how many of
    the ``total`` rows hold it). Keys of one in ``share`` of all rows or more, so ``share`` keys at most, are broadcast; what
    goes through the shuffle has no larger group than that."""
    named = groups.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in groups.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    drop = [f"_k{i}" for i in range(len(keys))]
    hot = F.col(size) * share >= total
    often = F.broadcast(named.where(hot))
    rest = rows.join(often, same, "left_anti").join(named.where(~hot), same)
    return rows.join(often, same).unionByName(rest).drop(*drop, size)
