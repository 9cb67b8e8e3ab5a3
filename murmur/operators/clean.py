"""Timestamps, missing values, dedup and the item union."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from murmur.functions.text import stringify
from murmur.sources.files import ORDINAL


def add_date(df: DataFrame, epoch_col: str = "created_utc", keep_timestamp: bool = True) -> DataFrame:
    """Epoch seconds -> UTC timestamp -> date."""
    ts = F.timestamp_seconds(F.col(epoch_col))
    out = df.withColumn("date", F.to_date(ts))
    return out.withColumn("created_ts", ts) if keep_timestamp else out


def available(df: DataFrame, columns: list[str]) -> list[str]:
    """U4: the subset of ``columns`` present in ``df`` (driver-side schema check)."""
    return [c for c in columns if c in df.columns]


def first_by(order_by: str | list[str], rest: list[str]):
    """The values of ``rest`` in the first row by ``order_by``, as a struct aggregate."""
    order = [order_by] if isinstance(order_by, str) else order_by
    return F.min_by(F.struct(*rest), F.struct(*order))


def dedup(df: DataFrame, keys: list[str], order_by: str | list[str] | None = None) -> DataFrame:
    """One row per key tuple (NULLs equal each other); the whole row when no key
    column exists. The kept row is the first by ``order_by`` (unique within a key group); rows that
    carry their place in the input (``ORDINAL``) need no argument: the first in file order stays, as one that is
    delivered again later, changed or not, is not news. A ``min_by`` aggregate: a hot duplicate group collapses
    map-side before the shuffle instead of landing in one window task."""
    keys = available(df, keys)
    if not keys:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    if order_by is None and len(available(df, ORDINAL)) == len(ORDINAL):
        order_by = ORDINAL
    # without an order keep the smallest remaining row: deterministic under
    # recomputation, unlike dropDuplicates(keys)
    pick = first_by(order_by, rest) if order_by is not None else F.min(F.struct(*rest))
    # structs are aggregated by sorting: the keys' hash leads, so few comparisons get to the keys themselves
    kept = df.groupBy(F.xxhash64(*keys).alias("_key_hash"), *keys).agg(pick.alias("_kept"))
    return kept.select(*keys, "_kept.*").select(*df.columns)


def dedup_posts(posts: DataFrame, order_by: str | list[str] | None = None) -> DataFrame:
    return dedup(posts, ["id", "author", "title", "created_utc"], order_by)


def dedup_comments(comments: DataFrame, order_by: str | list[str] | None = None) -> DataFrame:
    return dedup(comments, ["id", "author", "body", "created_utc"], order_by)


def clean_items(df: DataFrame) -> DataFrame:
    """Date from epoch, then drop rows with any missing value."""
    return add_date(df, keep_timestamp=False).na.drop("any")


def union_items(comments: DataFrame, posts: DataFrame, parity: bool = False, ord_col: str = "id") -> DataFrame:
    """Comments then posts as ``(item_id, date, kind, ord, text, score)``.

    ``kind`` (0 comment, 1 post) and ``ord`` fix the concatenation order that the original
    took from file order; where both sides carry their ordinal, its columns follow and say it exactly
    (:func:`item_order`). ``item_id`` = kind:id tells the two sources apart; it is as unique as the ids, and NULL for a NULL id."""
    ordinal = ORDINAL if set(ORDINAL) <= set(comments.columns) & set(posts.columns) else []

    def side(df, text_col, kind):
        return df.select(
            F.concat(F.lit(f"{kind}:"), F.col("id")).alias("item_id"),
            F.col("date"), F.lit(kind).alias("kind"), F.col(ord_col).alias("ord"),
            stringify(text_col, parity).alias("text"),
            F.col("score"), *ordinal)
    return side(comments, "body", 0).unionByName(side(posts, "title", 1))


def item_order(items: DataFrame) -> tuple[str, ...]:
    """The columns that put items into file order, comments first."""
    return ("kind", *(ORDINAL if set(ORDINAL) <= set(items.columns) else ["ord"]))
