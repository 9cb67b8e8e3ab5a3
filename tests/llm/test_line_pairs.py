"""Signatures, bounds and similarities of lines as DataFrame operations only."""

import random

from pyspark.sql import functions as F

from murmur.llm import line_dedup

from .test_operators import frame


def grams(x):
    return {x[j:j + 8] for j in range(max(1, len(x) - 7))}


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def odd_pairs():
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdeé😀") for _ in range(n))
    pairs = [("a", "a\0"), ("a", "b"), ("x" * 300, "x" * 20), ("short", "short"), ("abcdefgh" * 9, "abcdefgh" * 4)]
    for n in (3, 9, 16, 40, 150, 900):
        for part in (0.01, 0.03, 0.08, 0.3):
            for _ in range(4):
                x = word(n)
                pairs.append((x, "".join(c if r.random() > part else r.choice("xyz") for c in x)))
    return pairs


def test_similarity_and_bound_against_brute_force(spark):
    pairs = odd_pairs()
    rows = spark.createDataFrame([(i, -1 - i, x, y) for i, (x, y) in enumerate(pairs)], "a long, b long, la string, lb string")
    want = {i for i, (x, y) in enumerate(pairs) if near(grams(x.ljust(8, "\0")), grams(y.ljust(8, "\0")))}
    assert {x["a"] for x in line_dedup.similar(rows, 8, 80).collect()} == want and 0 < len(want) < len(pairs)
    texts = rows.select(F.col("a").alias("id"), F.col("la").alias("line")).unionByName(rows.select(F.col("b").alias("id"), F.col("lb").alias("line")))
    known = line_dedup.parities(texts, 8)
    sizes = {x["id"]: x["s"]["n"] for x in known.collect()}
    assert all(sizes[i] == len(grams(x)) and sizes[-1 - i] == len(grams(y)) for i, (x, y) in enumerate(pairs))
    both = rows.join(known.toDF("a", "s"), "a").join(known.toDF("b", "t"), "b")
    kept = {x["a"] for x in both.where(line_dedup.may_be_similar(F.col("s"), F.col("t"), 80)).collect()}
    assert want <= kept and len(kept) < (len(want) + len(pairs)) / 2


def test_no_python_on_the_executors(spark):
    found = line_dedup.lines(frame(spark, ["a line of words\nanother line of words"]), "doc_id", "text")
    uniq = found.select("id", "line").dropDuplicates(["id"])
    pairs = uniq.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("line").alias("la"), F.col("line").alias("lb"))
    for df in (line_dedup.band_keys(uniq, 8, 8, 3), line_dedup.parities(uniq, 8), line_dedup.similar(pairs, 8, 80)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    keys = line_dedup.band_keys(uniq, 8, 8, 3).collect()
    assert len(keys) == 2 and all(len(set(x["keys"])) == 8 for x in keys)


def test_unlike_variants_of_a_line_are_not_verified_pair_by_pair(spark, monkeypatch):
    r = random.Random(6)
    base = [f"{r.randrange(10**6)}" for _ in range(40)]
    lines = [" ".join(w if r.random() > 0.25 else f"{r.randrange(10**6)}" for w in base) for _ in range(120)]
    sets, verified, similar = [grams(x) for x in lines], [], line_dedup.similar

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(line_dedup, "similar", counted)
    monkeypatch.setattr(line_dedup, "band_keys", lambda uniq, *_: uniq.select("id", "line", F.array(F.lit(1).cast("long")).alias("keys")))
    got = line_dedup.line_dedup(frame(spark, ["\n".join(lines)])).first()
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if near(sets[a], sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    assert list(got["removed"]) == [i for i in range(len(lines)) if root[i] != i]
    assert sum(verified) <= len(lines) < len(lines) * (len(lines) - 1) // 20
