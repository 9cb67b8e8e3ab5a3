"""Recall on short lines and long unbroken runs, against brute force."""

import random

from murmur.llm import line_dedup

from .test_operators import frame


def test_short_lines_and_long_runs_are_found(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = [(f"{w} 2021", f"{w} 2022") for w in (word(13) for _ in range(60))]  # Jaccard 10 / 12
    pairs += [("A" + w, "B" + w) for w in (word(60) for _ in range(60))]
    rows = line_dedup.line_dedup(frame(spark, ["\n".join(p) for p in pairs])).collect()
    assert sum(x["n_removed"] for x in rows) >= 0.95 * len(pairs)
