"""F9/F10 numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(num, den) -> Column:
    """x / y with NULL for y = 0 (pandas gives inf, Spark ANSI raises)."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def engagement(comment_count="comment_count", score="score") -> Column:
    """1 + log1p(comment_count) + score / 100."""
    cc = F.col(comment_count) if isinstance(comment_count, str) else comment_count
    sc = F.col(score) if isinstance(score, str) else score
    return F.lit(1.0) + F.log1p(cc.cast("double")) + sc.cast("double") / F.lit(100.0)
