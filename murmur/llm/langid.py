"""Language ID by multilingual mixture inference.

Each language has a multinomial over hashed byte n-grams of lower-cased text, counted over all labelled
training rows. A document is a mixture of languages: expectation-maximisation finds the proportions that
maximise the likelihood of its n-grams. The set of languages grows from the single best one: the
language whose likelihood slope is steepest joins, the proportions are fitted anew, and the addition
stays only if the log-likelihood gains more than a penalty for the free proportion.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L* stands in the text (fractions, exponents and other numbers are none)."""
    return LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text))


#: ASCII bytes that are no letters become spaces.
KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SIZES = (3, 4)


def grams(text: str, buckets: int) -> np.ndarray:
    """Buckets of all byte n-grams of the text's words, a space at both ends."""
    raw = b" ".join(text.lower().encode("utf-8", "ignore").translate(KEEP).split())
    a = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(a) < n:
            continue
        code = np.full(len(a) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | a[j : len(a) - n + 1 + j]
        out.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(buckets - 1))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def train(docs: DataFrame, text: str, lang: str, buckets: int, alpha: float) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities (languages x buckets), from every row given."""

    def count(batches):
        for b in batches:
            total, held, size = {}, defaultdict(list), defaultdict(int)

            def add(x):
                new = np.bincount(np.concatenate(held.pop(x)), minlength=buckets)
                total[x] = total[x] + new if x in total else new
                size[x] = 0

            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[x].append(grams(t, buckets))
                size[x] += len(held[x][-1])
                if size[x] > 1 << 19:  # n-grams held at once: a few MB a language
                    add(x)
            for x in list(held):
                add(x)
            for x, c in total.items():
                g = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(c[g].astype(np.int64))], names=["lang", "g", "c"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    counts = rows.mapInArrow(count, "lang string, g int, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    dense = counts.groupBy("lang").agg(F.collect_list("g").alias("g"), F.collect_list("c").alias("c"))  # at most ``buckets`` entries each
    found = {r["lang"]: r for r in dense.collect()}
    langs = sorted(found)
    n = np.full((len(langs), buckets), alpha)
    for i, x in enumerate(langs):
        n[i, found[x]["g"]] += found[x]["c"]
    return langs, n / n.sum(axis=1, keepdims=True)


def _fit(p: np.ndarray, c: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """EM for the proportions of a mixture of the columns of p, with counts c: proportions, log-likelihood."""
    pi = start
    for _ in range(steps):
        share = p * pi
        mix = share.sum(axis=1)
        new = (c / mix) @ share / c.sum()
        if np.abs(new - pi).max() < 1e-3:
            pi = new
            break
        pi = new
    return pi, float(c @ np.log(p @ pi))


def infer(codes: np.ndarray, prob: np.ndarray, log_prob: np.ndarray, penalty: float, steps: int = 30) -> dict[int, float]:
    """``{language: proportion}`` of the selected set."""
    g, c = np.unique(codes, return_counts=True)
    c = c.astype(float)
    p = prob[:, g].T
    single = log_prob[:, g] @ c
    chosen, pi, best = [int(single.argmax())], np.ones(1), float(single.max())
    while len(chosen) < prob.shape[0]:
        slope = (c / (p[:, chosen] @ pi)) @ p
        slope[chosen] = 0
        add = int(slope.argmax())
        if slope[add] <= c.sum():  # no other language can raise the likelihood
            break
        start = np.append(pi * 0.9, 0.1)
        new, ll = _fit(p[:, [*chosen, add]], c, start, steps)
        if ll - best <= penalty * math.log(c.sum() + 1):
            break
        chosen, pi, best = [*chosen, add], new, ll
    return dict(zip(chosen, pi.tolist(), strict=True))


def identify(
    docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    buckets: int = 1 << 17, alpha: float = 0.1, penalty: float = 4.0,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score, languages`` (proportions of the selected set).

    ``labelled`` is what is learnt from: rows of a text and a language, all of them, nulls left out.
    The penalty is ``penalty * log(n-grams)`` nats a language: neighbouring n-grams overlap, so a
    passage counts several times what independent words would. The prediction is the
    language with the largest proportion (ties: first in order), the score that proportion. A null text or one
    without a letter, or nothing to learn from, gives ``und`` with score 0. The model that
    travels to the tasks has ``languages x buckets`` numbers, whatever the corpus.
    """
    spark = docs.sparkSession
    langs, prob = train(labelled, text, lang, buckets, alpha)
    sent = spark.sparkContext.broadcast((langs, prob.astype(np.float32)))

    @F.arrow_udf("struct<lang_pred: string, score: double, languages: map<string, double>>")
    def predict(texts: pa.Array) -> pa.Array:
        names, p = sent.value
        if getattr(predict_cache, "of", None) is not p:
            predict_cache.of, predict_cache.log = p, np.log(p)
        pred, score, sets = [], [], []
        for t in texts.to_pylist():
            if not t or not names or not has_letter(t):
                pred.append("und"), score.append(0.0), sets.append([])
                continue
            mix = infer(grams(t, buckets), p, predict_cache.log, penalty)
            top = min(mix, key=lambda x: (-mix[x], x))
            pred.append(names[top]), score.append(min(1.0, max(0.0, mix[top])))
            sets.append(sorted((names[x], v) for x, v in mix.items()))
        return pa.StructArray.from_arrays(
            [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
            names=["lang_pred", "score", "languages"],
        )

    return docs.select(F.col(doc_id).alias("doc_id"), predict(F.col(text)).alias("r")).select("doc_id", "r.*")


class predict_cache:  # noqa: N801
    """The logarithms of the broadcast model, made once a worker."""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lambda x: F.coalesce(F.crc32(F.col(x).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return identify(docs.select("doc_id", "text"), learn).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
