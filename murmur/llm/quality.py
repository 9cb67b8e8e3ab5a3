"""Quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed words and word pairs are counted: one of the trusted target (documents labelled
good and not toxic), one of the raw corpus (all documents). A document's score is its mean log ratio of the
two over its n-grams. Every document is held against one threshold; base rules on length and
repetition come first. DataFrame functions only: the counts are one aggregation, the scores one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pinned, table

SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 1_000_000
#: Bits of the table of trusted ids' hashes, as a power of two (at most 2^18 rows of 64 bits).
CELLS = 24
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, SPLIT)).otherwise(F.array().cast("array<string>"))


def _rest(w: Column, n: int) -> Column:
    """The words from the n-th (from 0) on."""
    return F.slice(w, F.lit(n + 1), F.greatest(F.size(w) - n, F.lit(0)))


def hashes(w: Column) -> Column:
    """A 64-bit hash of each word; n-grams are hashed from these, so a word's characters are read once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def pairs(h: Column) -> Column:
    """A hash of each pair of neighbours (``h``: the words' hashes; must be a lambda's variable or a column)."""
    return F.transform(_rest(h, 1), lambda x, i: F.xxhash64(F.get(h, i), x))


def buckets(h: Column, size: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours, by the words' hashes (``h`` must be a lambda's variable or a column)."""
    return F.transform(F.concat(h, pairs(h)), lambda x: F.pmod(x, F.lit(size)).cast("int"))


def repeat_words(h: Column) -> Column:
    """Words (given by their hashes) that lie in 3-word windows found twice or more in the text, first included. The windows' hashes are
    sorted with their places; equal neighbours are repeats; a window covers up to the next repeat's start."""
    windows = F.transform(_rest(h, 2), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))

    def places(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j)["h"] == x["h"])
        marked = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
        return F.sort_array(F.transform(marked, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gap = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = let(let(placed, places), covered)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0).cast("long"))  # most texts repeat none

    return let(windows, counted)


def base_counts(text: Column, w: Column, h: Column) -> list[Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text, its words and their hashes; zeros for null."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.when(full.rlike(f"[{SYMBOLS}]"), F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(h).alias("n_repeat_words"),
    ]


def mark(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``text, good``: every row of ``docs``, ``good`` 1 if its id is one of ``trusted`` (``_id``, distinct), else 0.

    The ids' hashes set bits of a table of ``1 << CELLS`` bits, which goes to all tasks. Texts whose bit is not set
    (or whose id is null) are not trusted and stay where they are; the others meet all trusted ids in a shuffle join,
    which decides. The fuller the bits, the more texts move; the result is the same.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << CELLS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), cell(c).bitwiseAND(F.lit(63)).cast("int"))
    bits = trusted.groupBy(F.shiftright(cell("_id"), 6).alias("_w")).agg(F.bit_or(bit("_id")).alias("_bits"))
    held = docs.select("doc_id", "text").join(F.broadcast(bits), F.shiftright(cell("doc_id"), 6) == F.col("_w"), "left")
    maybe = F.col("doc_id").isNotNull() & (F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(bit("doc_id")) != 0)
    sent = held.where(maybe).select("doc_id", "text").join(trusted.withColumn("_good", F.lit(1)).hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    return sent.select("text", F.coalesce("_good", F.lit(0)).alias("good")).unionByName(held.where(~maybe).select("text", F.lit(0).alias("good")))


def ratios(docs: DataFrame, labels: DataFrame, size: int, alpha: float) -> DataFrame:
    """``(bucket, llr)`` for every bucket that occurs: the log ratio of the trusted and the raw multinomial, in whole
    millionths of a nat, so that sums do not depend on their order. Both are smoothed by ``alpha`` occurrences of
    which the target holds its overall share, so that what was seen rarely says little, in a corpus of any size.

    The raw counts cover all documents, the target all trusted ones. Repeated label rows count once.
    """
    trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    grams = mark(docs, trusted).select("good", F.explode(let(hashes(words(F.col("text"))), lambda h: buckets(h, size))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    counts = pinned(counts, "ngrams")  # at most ``size`` rows
    total = counts.agg(F.sum("raw").alias("raw_n"), F.sum("good").alias("good_n"))
    share = F.col("good_n") / F.col("raw_n")
    neutral = total.select(F.coalesce(share, F.lit(0.0)).alias("s")).scalar()  # what any n-gram's share would be
    seen = (F.col("good") + alpha * neutral) / ((F.col("raw") + alpha) * neutral)
    llr = F.when(neutral > 0, F.log(seen)).otherwise(0.0)
    return counts.select("bucket", F.round(llr * UNIT).cast("long").alias("llr"))


def quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = 1 << 18, alpha: float = 10.0,
    threshold: float = -0.15, learn_from: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (``doc_id``), the base counts, ``base_failed, llr, kept``.

    ``llr`` is the mean log ratio over the words and pairs of words, 0 where there are none; ``kept`` is false if
    the base rules fail (under 50 words, or over half of the words in repeated windows), else whether ``llr`` is at
    least ``threshold``. Raw counts come from ``learn_from`` (default ``docs``), the target from its labelled rows.
    Null and empty texts have zero counts and fail the base rules. Null ids carry no label; repeated rows keep
    their rows and count as often as they stand. Without trusted rows all ratios have one smoothed target.
    """
    ratio = ratios(docs if learn_from is None else learn_from, labels, size, alpha)
    # the ratios by bucket become one array of ``size`` numbers (2 MB, whatever the corpus), looked up by place. A scalar
    # subquery holds it: a literal would be written out in every plan that Spark logs, hundreds of MB in the driver
    placed = docs.sparkSession.range(size).join(ratio, F.col("id") == F.col("bucket"), "left")
    placed = placed.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("llr", F.lit(0).cast("long")).alias("llr")))).alias("all"))
    names = keep or ["doc_id"]
    held = docs.select(*names, F.col(text).alias("_text"), placed.select(F.col("all.llr")).scalar().alias("_at"))

    def scored(h: Column, at: Column) -> Column:
        total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, x: a + F.get(at, F.pmod(x, F.lit(size)).cast("int")))
        return total(h) + total(pairs(h))

    judged = let(F.struct(words(F.col("_text")).alias("w"), F.col("_at").alias("at")), lambda x: let(hashes(x["w"]), lambda h: F.struct(
        *base_counts(F.col("_text"), x["w"], h), scored(h, x["at"]).alias("s"), F.greatest(2 * F.size(h) - 1, F.lit(0)).cast("long").alias("n"),
    )))

    def verdict(b: Column) -> Column:
        failed = (b["n_words"] < 50) | (b["n_repeat_words"] * 100 > b["n_words"] * 50)
        passed = b["s"] >= b["n"] * round(threshold * UNIT)
        mean = b["s"] / F.greatest(b["n"], F.lit(1)) / UNIT
        return F.struct(*(b[c].alias(c) for c in BASE), mean.alias("llr"), failed.alias("base_failed"), (~failed & passed).alias("kept"))

    # one struct with the verdict in it: a filter on ``kept`` that Spark pushes down then holds the whole expression once
    return held.select(*names, let(judged, verdict).alias("_b")).select(*names, *(F.col(f"_b.{c}") for c in [*BASE, "llr", "base_failed", "kept"]))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, whole; decided on id and text, so equal rows share their fate."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("_x"))
    judged = quality(own, table(spark, sf_dir, "labels"), keep=["doc_id", "_x"])
    good = judged.where("kept").select(F.col("doc_id").alias("_id"), "_x").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(docs["text"]) == good["_x"]), "left_semi")
