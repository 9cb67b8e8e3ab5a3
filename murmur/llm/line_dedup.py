"""Fuzzy line dedup by MinHash.

A line's signature is the least value of each of ``bands * rows`` hash functions over all its overlapping character
shingles. Lines that agree in all rows of a band are candidates. Candidates that a bound cannot rule out are verified by
the exact Jaccard similarity of the same shingles, and linked ones are joined by distributed union-find; one line of each
component is kept. Shingles are rows inside a task: they are cut, hashed and folded there and never shuffled by themselves.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_size, pinned, table
from .components import components

#: Leaders of a bucket in the second round; a bucket with more lines than ``FULL`` after it is dealt anew by prefix tokens.
LEADERS, FULL = 8, 2000
#: Shingles that one row takes, and 64-bit words of a line's parities.
RUN, WORDS = 16, 16
SPACE = " \t\n\x0b\x0c\r"


def lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, th (hash of the text), line_no, line, id``: the lines with a character that is no space, trimmed."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))
    rows = rows.select("doc_id", "th", "line_no", F.btrim("raw", F.lit(SPACE)).alias("line")).where("line != ''")
    return rows.withColumn("id", F.xxhash64("line"))


def _wide(line: Column, k: int) -> Column:
    """The line in four bytes a character, so that a shingle is found by its place; a shorter line is filled up to one shingle."""
    return F.encode(F.when(F.length(line) < k, F.rpad(line, k, "\0")).otherwise(line), "UTF-32")


def _runs(rows: DataFrame, ids: list[str], line: str, k: int) -> DataFrame:
    """``ids`` and ``c0`` and so on: the codes of ``RUN`` shingles of a line in each row; the last one stands in for those beyond the end."""
    last = F.octet_length("w") - (4 * k - 1)
    wide = rows.select(*ids, _wide(F.col(line), k).alias("w"))
    wide = wide.select("*", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(4 * RUN))).alias("i"))
    at = [F.least(F.col("i") + 4 * j, "last") for j in range(RUN)]
    return wide.select(*ids, *(F.xxhash64(F.substring("w", x, F.lit(4 * k))).alias(f"c{j}") for j, x in enumerate(at)))


def band_keys(uniq: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``id, line, keys``: the keys of the bands of each line (``id, line``, ids unique). Hash functions are odd factors of
    31 bits of a shingle's code."""
    r, low = random.Random(0), (1 << 31) - 1
    factors = [r.randrange(1 << 30) * 2 + 1 for _ in range(bands * rows)]
    codes = _runs(uniq, ["id"], "line", k).select("id", *(F.col(f"c{j}").bitwiseAND(low).alias(f"c{j}") for j in range(RUN)))
    least = [F.min(F.least(*((F.col(f"c{j}") * f).bitwiseAND(low) for j in range(RUN)))).alias(f"m{i}") for i, f in enumerate(factors)]
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col(f"m{i * rows + j}") for j in range(rows))) for i in range(bands)))
    signed = codes.groupBy("id").agg(*least).select("id", keys.alias("keys"))
    return uniq.select("id", "line").join(signed.hint("shuffle_hash"), "id")


def shingles(texts: DataFrame, k: int) -> DataFrame:
    """``id, token``: the different shingles of each line (``id, line``, ids unique) as 64-bit codes."""
    runs = _runs(texts.repartition("id"), ["id"], "line", k).select("id", F.array(*(f"c{j}" for j in range(RUN))).alias("run"))
    found = runs.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("run"))).alias("tokens"))
    return found.select("id", F.explode("tokens").alias("token"))


def parities(texts: DataFrame, k: int) -> DataFrame:
    """``id, s``: the number ``n`` of different shingles of each line, and for each of ``64 * WORDS`` hash values whether an odd number
    of them has it."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned("token", 6).bitwiseAND(WORDS - 1)
    odd = [F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    found = shingles(texts, k).select("id", word.alias("word"), bit.alias("bit")).groupBy("id").agg(F.count("*").alias("n"), *odd)
    return found.select("id", F.struct("n", *(f"w{i}" for i in range(WORDS))).alias("s"))


def may_be_similar(s: Column, t: Column, percent: int) -> Column:
    """False only where the Jaccard similarity is below ``percent``: each parity in which two lines differ is a shingle that one of
    them lacks, at least. In whole numbers."""
    differ = reduce(add, (F.bit_count(s[f"w{i}"].bitwiseXOR(t[f"w{i}"])) for i in range(WORDS)))
    both = s["n"] + t["n"]
    return (F.least(s["n"], t["n"]) * 100 >= F.greatest(s["n"], t["n"]) * percent) & ((both - differ) * 100 >= (both + differ) * percent)


def similar(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs (``a, b, la, lb``: two ids and their lines) whose shingles have a Jaccard similarity of ``percent`` or more,
    in whole numbers. The shingles of both lines stand in one row of a task."""
    side = lambda n, x: F.struct(F.lit(n).alias("side"), F.col(x).alias("line"))
    sides = pairs.select("a", "b", F.explode(F.array(side(1, "la"), side(2, "lb"))).alias("x")).select("a", "b", "x.*")
    runs = _runs(sides, ["a", "b", "side"], "line", k).select("a", "b", "side", F.array(*(f"c{j}" for j in range(RUN))).alias("run"))
    of = lambda n: F.flatten(F.collect_list(F.when(F.col("side") == n, F.col("run"))))
    held = runs.groupBy("a", "b").agg(of(1).alias("ta"), of(2).alias("tb"))
    both, either = F.size(F.array_intersect("ta", "tb")).cast("long"), F.size(F.array_union("ta", "tb"))
    return held.where(both * 100 >= either * percent).select("a", "b")


def prefix_tokens(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, token``: the rarest shingles (as codes; counted over ``texts``: ``id, line``, ids unique) of each line, so many that two
    lines of a similarity of ``percent`` share one: of n, all but those that the least possible intersection leaves over."""
    each = pinned(shingles(texts, k), "tokens")
    often = pinned(each.groupBy("token").agg(F.count("*").alias("n")).withColumn("often", F.col("n")), "often")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = join_by_size(each, often, ["token"], "n", total).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))
    size = F.size("t")
    return ordered.select("id", F.explode(F.slice("t", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)).alias("t")).select("id", "t.token")


def line_links(found: DataFrame, k: int, bands: int, rows: int, percent: int) -> DataFrame:
    """``(a, b)``: verified links between different lines that connect all candidates that are similar.

    In each round some of a bucket's lines lead: they are held against all its other lines that are not yet in their
    component, linked ones included, and then leave. First the least and the greatest id lead, then about ``LEADERS`` lines, and four
    times as many in each further round. A bucket ends when its remaining lines are in one component, whatever other
    buckets do; so each pair of a bucket is compared or already connected. The lines of buckets that keep over ``FULL`` lines after
    the first two rounds are dealt anew, once, by their prefix tokens, before the rounds go on: similar lines share a token, so no
    pair is lost, whatever ``FULL`` is.
    """
    uniq = found.select("id", "line").dropDuplicates(["id"])  # copies meet in tasks first
    signed = pinned(band_keys(uniq, k, bands, rows), "signatures")  # lines beside their keys: the texts are split and made distinct once
    keyed = signed.select("id", F.explode("keys").alias("key"))
    ends = keyed.repartition("key").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    ends = pinned(ends, "ends")
    # two lines in a bucket are its leaders; only fuller buckets are joined to their lines
    full = pinned(ends.where("n > 2").select("key", "lo", "hi"), "full")
    led = pinned(keyed.join(full, "key"), "buckets")
    two = ends.where("n = 2").select(F.col("lo").alias("x"), F.col("hi").alias("y")).distinct()
    wanted = led.select("id").unionByName(two.select(F.explode(F.array("x", "y")).alias("id"))).distinct()
    texts = pinned(signed.select("id", "line").join(wanted, "id", "left_semi"), "lines")
    known = pinned(parities(texts, k), "parities")
    of = lambda x, s: known.select(F.col("id").alias(x), F.col("s").alias(s))
    likely = may_be_similar(F.col("s"), F.col("t"), percent)

    def held(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"l{x}"))
        return pinned(similar(pairs.join(side("a"), "a").join(side("b"), "b"), k, percent), "held")

    lead = full.select("key", F.explode(F.array("lo", "hi")).alias("y")).join(of("y", "t"), "y")
    pairs = led.select("key", F.col("id").alias("x")).join(of("x", "s"), "x").join(lead, "key").where(likely).select("x", "y")
    every = held(pairs.unionByName(two.join(of("x", "s"), "x").join(of("y", "t"), "y").where(likely).select("x", "y")))
    rest, leaders, dealt = led.where("id != lo AND id != hi").select("key", "id"), LEADERS, False
    while True:
        roots = components(every, "a", "b", "lines").withColumnRenamed("node", "id")
        rest = rest.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("part"))
        rest = pinned(rest, "buckets")
        sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
        rest = pinned(rest.join(sizes.select("key", "n"), "key"), "open")
        if rest.isEmpty():
            return every
        if leaders > LEADERS and not dealt:
            dealt, big = True, rest.where(F.col("n") > FULL)
            big = big.select("id", "part").distinct()
            again = prefix_tokens(texts.join(big, "id", "left_semi"), k, percent).join(big, "id")
            again = again.select(F.xxhash64("token", F.lit("token")).alias("key"), "id", "part")
            again = again.join(again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
            rest = pinned(rest.where(F.col("n") <= FULL).unionByName(again.select("key", "id", "part", "n")), "dealt")
        # a line leads by its own hash, so no bucket is sorted; all lead where there are few
        rest = rest.withColumn("leads", F.pmod(F.xxhash64("id", "key", F.lit(leaders)), F.col("n")) < leaders)
        sides = rest.join(known, "id")
        first = sides.where("leads").select("key", F.col("id").alias("y"), F.col("part").alias("other"), F.col("s").alias("t"))
        pairs = sides.select("key", F.col("id").alias("x"), "part", "s").join(first, "key").where((F.col("part") != F.col("other")) & likely)
        every = every.unionByName(held(pairs.select("x", "y")))
        rest, leaders = rest.where("NOT leads").select("key", "id"), leaders * 4


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 8, bands: int = 8, rows: int = 3, percent: int = 80
) -> DataFrame:
    """One row per document row: ``doc_id, n_lines, n_removed, removed`` (numbers of the lines that go, from 0, sorted).

    Of all occurrences of a component's lines, the one with the smallest document id (then hash of the text, then line
    number) stays. Lines without a character other than a space are not compared and stay; so does everything else
    that is unlike all other lines. Null and empty texts have no lines. Null ids come first in the order. Rows that are
    equal in id and text are one document and share their result. Lines are told apart by a 64-bit hash.
    """
    found = lines(docs, doc_id, text)
    roots = components(line_links(found, k, bands, rows, percent), "a", "b", "lines").select(F.col("node").alias("id"), "root")
    at = F.struct("doc_id", "th", "line_no")
    placed = found.select("doc_id", "th", "line_no", "id").join(roots, "id", "left").select(at.alias("at"), F.coalesce("root", "id").alias("part"))
    placed = pinned(placed, "occurrences")
    many = placed.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    placed = pinned(placed.join(many, "part", "left_semi"), "repeated")  # a line that is alone stays, whatever else there is
    first = placed.groupBy("part").agg(F.min("at").alias("first"))
    gone = placed.join(first, "part").where(F.col("at") != F.col("first"))
    gone = gone.select("at.*").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")).cast("long")
    rows_ = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), n_lines.alias("n_lines"))
    out = rows_.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i)), "\n")


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))
