"""Join helpers: a size-checked broadcast and the replace-column join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows a side may hold to be broadcast explicitly. Above it, the join stays a shuffle join
# and AQE may still convert it at run time from measured shuffle sizes.
BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    The check is one bounded action (``limit(max_rows + 1).count()``); beyond the bound the
    frame is returned unchanged so the planner falls back to a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def replace_column(target: DataFrame, source: DataFrame, on: list[str], column: str,
                   fill=0.0) -> DataFrame:
    """Drop a stale column, left-join the fresh one, fill the gaps."""
    base = target.drop(column)
    fresh = source.select(*on, column)
    return base.join(fresh, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(fill)))


def semi_prune(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keep rows whose key occurs in ``keys`` — placed below costly scoring by construction."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")
