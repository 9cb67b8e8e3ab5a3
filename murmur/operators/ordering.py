"""Global order without a single task: range-partitioned prefix sums, exact quantiles,
reproducible samples (O4).

``range_prefix`` is the one primitive: rows are range-partitioned on the order key (so a
hot group is spread over many tasks), each partition computes local running sums in one
Arrow pass, the partition totals (one row per partition and group: bounded by the
partition count plus the group count) give each partition its starting offset. The
intermediate is checkpointed to the shared checkpoint folder so that recomputation after
an executor loss sees the same partition assignment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from murmur.operators.joins import bounded_broadcast
from murmur.operators.partitioning import estimated_bytes
from murmur.session import default_parallelism, ensure_checkpoint_dir, ship_package


TARGET_PARTITION_BYTES = 64 << 20


def _num_partitions(df: DataFrame, requested: int | None, part_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Range partitions: ``part_bytes`` of scanned input each, at least the cluster's parallelism,
    at most the configured shuffle partitions (which a cluster sizes for its data)."""
    if requested:
        return requested
    spark = df.sparkSession
    shuffle = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    par = max(default_parallelism(spark), 1)
    est = estimated_bytes(df)
    if est is None:
        return shuffle
    want = -(-est // part_bytes)
    return max(min(par, shuffle), min(shuffle, want))


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether values differ, place by place; nulls are equal, and so are NaNs."""
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(a.type):
        unlike = unlike & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return unlike | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)


def range_prefix(df: DataFrame, order_cols: list[str], group_cols: list[str] | None = None,
                 weight_col: str | None = None, out_col: str = "_before",
                 num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add ``out_col`` = sum of ``weight_col`` (1 when None) over the rows strictly before
    each row within its group, in ``order_cols`` order. ``group_cols + order_cols`` should
    be unique; ties get an arbitrary but consistent order. Also adds ``_group_total``."""
    group_cols = list(group_cols or [])
    keys = group_cols + [c for c in order_cols if c not in group_cols]
    n = _num_partitions(df, num_partitions)
    w = weight_col
    staged = df if w else df.withColumn("_w1", F.lit(1).cast("long"))
    w = w or "_w1"
    srt = staged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    wtype = srt.schema[w].dataType
    acc_type = T.DoubleType() if isinstance(wtype, (T.DoubleType, T.FloatType)) else T.LongType()
    schema = T.StructType(srt.schema.fields + [T.StructField("_pid", T.IntegerType()),
                                               T.StructField("_local", acc_type)])

    def local_sums(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last, acc = None, 0  # the group of the row before and its sum so far
        for batch in batches:
            if not batch.num_rows:
                continue
            weights = np.nan_to_num(pc.fill_null(batch.column(w), 0).to_numpy(zero_copy_only=False), posinf=np.inf, neginf=-np.inf)
            n = len(weights)
            first = np.zeros(n, bool)  # rows are sorted: a group is a run
            for c in group_cols:
                first[1:] |= _differs(batch.column(c).slice(1), batch.column(c).slice(0, n - 1))
                first[0] |= last is not None and _differs(batch.column(c).slice(0, 1), last[c])[0]
            runs = np.cumsum(first)
            local = pd.Series(weights).groupby(runs).cumsum().to_numpy() - weights
            local = np.where(runs == 0, local + acc, local).astype("float64" if acc_type == T.DoubleType() else "int64")
            acc, last = local[-1] + weights[-1], {c: batch.column(c).slice(n - 1) for c in group_cols}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(local)], names=[*batch.schema.names, "_pid", "_local"])

    ship_package(df.sparkSession)
    local = srt.mapInArrow(local_sums, schema)
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        local = local.checkpoint(eager=True)
    totals = local.groupBy("_pid", *group_cols).agg(F.sum(w).alias("_ptotal"))
    gw = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    offs = totals.select(
        "_pid", *group_cols,
        F.coalesce(F.sum("_ptotal").over(gw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_poff"),
        F.sum("_ptotal").over(Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1)))
        .alias("_group_total"))
    # offs holds at most (#partitions + #groups) rows; NULL is a group like any other
    offs = offs.withColumnsRenamed({c: f"_o_{c}" for c in ["_pid", *group_cols]})
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) if c in group_cols else F.col(c) == F.col(f"_o_{c}") for c in ["_pid", *group_cols]]
    out = local.join(bounded_broadcast(offs), same, "inner").drop(*(f"_o_{c}" for c in ["_pid", *group_cols]))
    out = out.withColumn(out_col, (F.col("_local") + F.col("_poff")).cast(acc_type))
    drop = ["_pid", "_local", "_poff"] + (["_w1"] if weight_col is None else [])
    return out.drop(*drop)


def ranked_values(df: DataFrame, value_col: str, group_cols: list[str] | None = None,
                  num_partitions: int | None = None) -> DataFrame:
    """Distinct non-null values per group with their count ``_cnt``, rank offset ``_before``
    and group size ``_group_total`` (checkpointed: reuse it for several statistics)."""
    group_cols = list(group_cols or [])
    vals = df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    return range_prefix(vals, [value_col], group_cols, "_cnt", "_before", num_partitions)


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    group_cols: list[str] | None = None, num_partitions: int | None = None,
                    ranked: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``) per group.

    Distinct values are counted first (map-side), then ranked globally with
    :func:`range_prefix`; only the <= 2 rows per requested probability that bracket the
    target rank are kept. Returns ``(*group_cols, p, value)``."""
    group_cols = list(group_cols or [])
    if ranked is None:
        ranked = ranked_values(df, value_col, group_cols, num_partitions)
    pos = F.col("p") * (F.col("_group_total") - 1)
    cand = ranked.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    lo, hi = F.floor(pos), F.ceil(pos)
    covers = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_cnt"))
    picked = cand.where(covers(lo) | covers(hi)).select(
        *group_cols, "p", value_col, F.when(covers(lo), 1).otherwise(0).alias("_is_lo"),
        F.when(covers(hi), 1).otherwise(0).alias("_is_hi"), (pos - lo).alias("_frac"))
    agg = picked.groupBy(*group_cols, "p").agg(
        F.max(F.when(F.col("_is_lo") == 1, F.col(value_col))).alias("_vlo"),
        F.max(F.when(F.col("_is_hi") == 1, F.col(value_col))).alias("_vhi"),
        F.first("_frac").alias("_frac"))
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    return agg.select(*group_cols, "p", F.when(F.col("_frac") == 0, F.col("_vlo")).otherwise(value).alias("value"))


def seeded_sample(df: DataFrame, key_col: str, n: int, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows without replacement, the same rows on any partitioning and
    in any engine: order by md5('<seed>:<key>') and take the first n (a distributed top-k)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key_col).limit(n).drop("_h")
