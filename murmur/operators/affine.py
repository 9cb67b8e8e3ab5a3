"""W7 for any noise ratio and with missing observations: the filter as an associative scan.

One step of the local-level filter with variance P and mean x, written in homogeneous coordinates (u, s, w) with
P = u / w and x = s / w, is a linear map: with transition noise q, observation noise r and observation z

    u' = r u + r q w        s' = z u + r s + q z w        w' = u + (q + r) w

and without an observation u' = u + q w, s' = s, w' = w. Products of 3 x 3 matrices are associative, so a series need
not be walked by one task: rows are range partitioned by (series, time), every partition multiplies its own maps
by doubling, the product of each partition's share of a series (a row a partition and series) is folded into the state
before it, and each row's prefix is applied to that state. All entries are sums of products of the data without
differences, and a product is scaled after each step (a state's scale means nothing), so nothing cancels or overflows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from murmur.operators.joins import bounded_broadcast
from murmur.operators.ordering import _num_partitions
from murmur.session import ensure_checkpoint_dir, ship_package

_M = [f"_m{i}{j}" for i in range(3) for j in range(3)]


def step_maps(z: np.ndarray, q: float, r: float) -> np.ndarray:
    """The map of each observation; NaN is a missing one."""
    seen = ~np.isnan(z)
    v, out = np.where(seen, z, 0.0), np.zeros((len(z), 3, 3))
    out[:, 0, 0], out[:, 0, 2] = np.where(seen, r, 1.0), np.where(seen, r * q, q)
    out[:, 1, 0], out[:, 1, 1], out[:, 1, 2] = v, np.where(seen, r, 1.0), q * v
    out[:, 2, 0], out[:, 2, 2] = seen, np.where(seen, q + r, 1.0)
    return out


def prefix_products(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The product of all maps from the start of a row's run up to the row (the latest leftmost), by doubling."""
    out, first, n = maps / np.abs(maps).max((1, 2), keepdims=True), starts.copy(), len(maps)
    d = 1
    while d < n:
        open_ = np.flatnonzero(~first[d:]) + d  # rows whose product does not reach their run's start yet
        out[open_] = out[open_] @ out[open_ - d]
        out[open_] /= np.abs(out[open_]).max((1, 2), keepdims=True)
        reached = first.copy()
        reached[open_] = first[open_ - d]
        first, d = reached, d * 2
    return out


def kalman_scan(df: DataFrame, keys="symbol", order: str = "date", value="close", out: str = "kalman_close", transition_noise: float = 1.0,
                observation_noise: float = 1.0, initial_variance: float = 1.0, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``, the filtered mean of ``value`` per series: it starts at the series' first observation, predicted with
    ``initial_variance``, as :func:`murmur.operators.timeseries.kalman_filter` does with unit noises. A row without a value keeps
    the mean before it and widens the variance; before the first observation the mean is NULL. ``keys`` + ``order`` should
    be unique."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    q, r = float(transition_noise), float(observation_noise)
    sort = [*keys, order]
    # the keys as one text: what pandas compares, and what joins a run to its state (NULL keys equal)
    z = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    narrow = df.select(*sort, z.alias("_z"), F.to_json(F.struct(*keys)).alias("_run"))
    firsts = narrow.where("_z IS NOT NULL").groupBy("_run").agg(F.min(order).alias("_since"), F.min_by("_z", order).alias("_first"))
    narrow = narrow.join(bounded_broadcast(firsts), "_run").where(F.col(order) >= F.col("_since")).drop("_since", "_first")
    placed = narrow.repartitionByRange(_num_partitions(df, num_partitions), *sort).sortWithinPartitions(*sort)
    schema = T.StructType([*placed.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_at", T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in _M)])

    def products(batches):
        from pyspark import TaskContext

        pid, at, last, held = TaskContext.get().partitionId(), 0, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            run = pdf["_run"].to_numpy()
            starts = np.r_[True, run[1:] != run[:-1]]
            got = prefix_products(step_maps(pdf["_z"].to_numpy(dtype=float), q, r), starts)
            if last == run[0]:  # the run goes on from the batch before
                head = slice(0, int(np.argmax(starts[1:])) + 1 if starts[1:].any() else len(run))
                got[head] = got[head] @ held
                got[head] /= np.abs(got[head]).max((1, 2), keepdims=True)
            last, held = run[-1], got[-1]
            cols = pd.DataFrame(got.reshape(-1, 9), columns=_M, index=pdf.index)
            yield pd.concat([pdf.assign(_pid=np.int32(pid), _at=np.arange(at, at + len(pdf))), cols], axis=1)
            at += len(pdf)

    ship_package(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    scanned = placed.mapInPandas(products, schema).checkpoint(eager=True)
    shares = scanned.groupBy("_run", "_pid").agg(F.max_by(F.struct(*_M), "_at").alias("m"))

    def times(m, v):
        new = [m[f"_m{i}0"] * v["u"] + m[f"_m{i}1"] * v["s"] + m[f"_m{i}2"] * v["w"] for i in range(3)]
        size = F.greatest(*(F.abs(c) for c in new))
        return F.struct(*((c / size).alias(n) for c, n in zip(new, "usw")))

    # a series' shares in order, one for each partition that holds some of it, folded into the state before each
    line = shares.groupBy("_run").agg(F.array_sort(F.collect_list(F.struct("_pid", "m"))).alias("line")).join(firsts, "_run")
    start = F.struct(F.lit(float(initial_variance) - q).alias("u"), F.col("_first").alias("s"), F.lit(1.0).alias("w"))
    states = F.aggregate("line", F.array(start), lambda acc, x: F.array_append(acc, times(x["m"], F.element_at(acc, -1))))
    before = line.withColumn("_states", states).select("_run", F.posexplode("line").alias("_i", "x"), "_states")
    before = before.select("_run", F.col("x._pid").alias("_pid"), F.get("_states", F.col("_i")).alias("_v"))
    got = scanned.join(before, ["_run", "_pid"])
    state = times(F.struct(*_M), F.col("_v"))
    got = got.select(*sort, (state["s"] / state["w"]).alias(out))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"g.{c}")) for c in sort]
    base = [c for c in df.columns if c != out]
    return df.alias("l").join(got.alias("g"), same, "left").select(*(F.col(f"l.{c}") for c in base), F.col(f"g.{out}"))
