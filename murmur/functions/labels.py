"""D1/D2 threshold labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from murmur import config


def three_class(c) -> Column:
    """> cut positive, < -cut negative, else (and NULL) neutral."""
    c = F.col(c) if isinstance(c, str) else c
    cut = config.THREE_CLASS_CUT
    return (F.when(c > cut, "positive").when(c < -cut, "negative").otherwise("neutral"))


def five_class(c) -> Column:
    """Checked in order >= .75, >= .25, <= -.75, <= -.25, else (and NULL) Neutral."""
    c = F.col(c) if isinstance(c, str) else c
    hi, mid = config.FIVE_CLASS_EXTREME, config.FIVE_CLASS_MILD
    return (F.when(c >= hi, "Extremely Positive").when(c >= mid, "Positive")
            .when(c <= -hi, "Extremely Negative").when(c <= -mid, "Negative")
            .otherwise("Neutral"))
