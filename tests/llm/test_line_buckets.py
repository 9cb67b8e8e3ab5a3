"""All pairs of a bucket are compared or connected."""

import random

import pytest
from pyspark.sql import functions as F

from murmur.llm import line_dedup

from .test_operators import frame


@pytest.mark.parametrize("full", [2000, 20])
def test_chains_in_one_bucket(spark, monkeypatch, full):
    r, lines = random.Random(3), []
    for _ in range(12):  # chains: only neighbours are similar
        line = [f"{r.randrange(10**6)}" for _ in range(20)]
        for j in range(10):
            line = [*line[1:], f"{r.randrange(10**6)}"]
            lines.append(" ".join(line))
    lines += [" ".join(f"{r.randrange(10**6)}" for _ in range(20)) for _ in range(60)]
    grams = [{x[j:j + 8] for j in range(len(x) - 7)} for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    monkeypatch.setattr(line_dedup, "band_keys", lambda uniq, *_: uniq.select("id", "line", F.array(F.lit(1).cast("long")).alias("keys")))
    monkeypatch.setattr(line_dedup, "FULL", full, raising=False)
    got = line_dedup.line_dedup(frame(spark, ["\n".join(lines)])).first()
    assert list(got["removed"]) == [i for i in range(len(lines)) if root[i] != i]
