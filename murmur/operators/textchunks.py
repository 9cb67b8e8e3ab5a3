"""The day's texts joined with a space, cut into fixed-size chunks — without
ever building the day's string in one row.

Items are dealt by range of (day, order), so a hot day is spread over many tasks, and carry their texts: each text
is shuffled once. The characters of each part and day (one row each: bounded by the parts and the days) give a part's
place inside its days; a task then cuts its sorted texts as they come, at the chunks' borders. Chunks that parts share
are put together from their pieces, so every group is bounded by ``chunk_chars`` characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from murmur import config
from murmur.operators.ordering import _differs, _num_partitions
from murmur.session import ensure_checkpoint_dir, ship_package

#: Scanned bytes for each range of items: a task sorts some ten times as much.
RANGE_BYTES = 16 << 20


def daily_chunks(items: DataFrame, chunk_chars: int = config.CHUNK_CHARS,
                 date_col: str = "date", order_cols=("kind", "ord"), text_col: str = "text",
                 num_partitions: int | None = None) -> DataFrame:
    """``(date, chunk, text)``: chunk k holds characters [k*C, (k+1)*C) of the day's texts
    joined by single spaces in ``order_cols`` order (then by a hash of the text); a day with no
    characters has one empty chunk. Null and repeated keys keep all their rows."""
    C = chunk_chars
    base = items.select(date_col, *order_cols, F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")).alias("_t"))
    tie = F.xxhash64("_t")
    dealt = base.repartitionByRange(_num_partitions(base, num_partitions, RANGE_BYTES), date_col, *order_cols, tie)
    if items.sparkSession.conf.get("spark.sql.exchange.reuse", "true") != "true":
        # the ranges are drawn from a sample: both readings below must be of the same shuffle
        ensure_checkpoint_dir(items.sparkSession)
        dealt = dealt.checkpoint(eager=True)
    part = F.spark_partition_id().alias("_pid")
    per = dealt.select(part, date_col, F.length("_t").cast("long").alias("_len")).groupBy("_pid", date_col).agg(
        F.sum("_len").alias("_chars"), F.count(F.lit(1)).alias("_rows"))
    day = Window.partitionBy(date_col)
    before = F.coalesce(F.sum("_chars").over(day.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_chars").over(day)
    # a part's characters [_off, _end) of the day; no separator after the last text
    places = per.select(F.col("_pid").alias("_p"), F.col(date_col).alias("_day"), "_rows", before.alias("_off"), total.alias("_all")).select(
        "_p", "_day", "_rows", "_off", (F.col("_all") - 1).alias("_all"))
    here = dealt.select("*", part).join(F.broadcast(places), (F.col("_pid") == F.col("_p")) & F.col(date_col).eqNullSafe(F.col("_day")), "left")
    texts = here.withColumn("_x", tie).sortWithinPartitions(date_col, *order_cols, "_x").select("_pid", date_col, "_off", "_all", "_rows", "_t")
    schema = T.StructType([T.StructField(date_col, texts.schema[date_col].dataType), T.StructField("chunk", T.LongType()),
                           T.StructField("_start", T.LongType()), T.StructField("_piece", T.StringType())])
    ship_package(items.sparkSession)
    pieces = texts.mapInArrow(_cutter(date_col, C), schema)
    return pieces.groupBy(date_col, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_piece"))),
                                 lambda s: s["_piece"]), "").alias("text"))


def _cutter(date_col: str, size: int):
    """Arrow batches of a part's sorted ``_pid, date, _off, _all, _rows, _t`` to its pieces ``date, chunk, _start, _piece``: the
    day's characters from ``_off`` on, cut at multiples of ``size`` and at ``_all``. Between batches it holds less than a chunk."""

    def cut(batches):
        day = at = end = to_come = last = None  # the run of rows of a part and day: its next place, its end, its rows to come
        held = ""

        def taken():
            """What is cut off ``held``: whole pieces, and the rest as well after the run's last row."""
            nonlocal at, held
            begun = 0
            if not to_come and end == 0:
                yield day, 0, 0, ""
            while (n := min(size - at % size, end - at)) > 0:
                have = len(held) - begun
                if not have or n > have and to_come:
                    break
                n = min(n, have)
                yield day, at // size, at, held[begun:begun + n]
                at, begun = at + n, begun + n
            held = held[begun:]

        def check(right):
            if not right:
                raise RuntimeError("the texts were dealt otherwise than when their characters were counted")

        for batch in batches:
            n, out = batch.num_rows, []
            if not n:
                continue
            keys = [batch.column("_pid"), batch.column(date_col)]
            check(not to_come or not any(_differs(k.slice(0, 1), l)[0] for k, l in zip(keys, last)))
            first = np.logical_or(*(_differs(k.slice(1), k.slice(0, n - 1)) for k in keys))
            borders = [0, *(np.flatnonzero(first) + 1).tolist(), n]
            for a, b in zip(borders, borders[1:]):
                if not to_come:
                    day, at, end, to_come = (batch.column(c)[a].as_py() for c in (date_col, "_off", "_all", "_rows"))
                    held = ""
                    check(to_come)
                to_come -= b - a
                check(to_come == 0 or to_come > 0 and b == n)
                held += _joined(batch.column("_t").slice(a, b - a))
                out += taken()
            last = [k.slice(n - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], keys[1].type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                pa.array([x[3].encode("utf-8", "surrogateescape") for x in out], pa.binary()).view(pa.string())],
                names=[date_col, "chunk", "_start", "_piece"])
        check(not to_come)

    return cut


def _joined(texts: pa.Array) -> str:
    """Texts that lie one after another in an Arrow array are one run of bytes (bytes that are no UTF-8 stay what they are)."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    places = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1]
    return bytes(texts.buffers()[2][int(places[0]):int(places[-1])]).decode("utf-8", "surrogateescape")
