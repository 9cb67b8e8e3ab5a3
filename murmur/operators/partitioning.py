"""Parallelism guard for CPU-heavy per-row stages (tokenising, model scoring).

A scan yields one task per file split; a small table stored as one row group is a single
task, and a per-row text stage on it would use one core. ``spread`` redistributes rows
round-robin only when the scans under it read less than
``maxPartitionBytes x parallelism`` — i.e. when the scan cannot have produced enough
splits. On a large input (or an unknown estimate) it returns the frame untouched, so it
never adds a shuffle at scale. Nothing is executed to decide (``df.rdd`` would run the
upstream shuffle stages of an adaptive plan eagerly).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from murmur.session import default_parallelism


def _bytes(conf_value: str) -> int:
    v = conf_value.strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    for suffix in ("b", ""):
        for u, mult in units.items():
            if v.endswith(u + suffix) and v[: -len(u + suffix)].isdigit():
                return int(v[: -len(u + suffix)]) * mult
    return int(v.rstrip("b"))


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes the plan reads: the summed size estimates of its leaf relations (logical
    statistics of the scans; no job is run). Joins are not multiplied out; a leaf without
    statistics (an RDD) makes the answer unknown."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            total += int(str(leaves.apply(i).stats().sizeInBytes()))
        return total
    except Exception:  # noqa: BLE001 - estimate unavailable
        return None


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    if df.isStreaming:
        return df
    spark = df.sparkSession
    target = min_partitions or default_parallelism(spark)
    size = estimated_bytes(df)
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    if size is None or size >= split * target:
        return df
    return df.repartition(target)
