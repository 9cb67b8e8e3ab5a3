"""Mixing sources to target weights, with soft domain membership.

A classifier learnt from the label table gives each document a posterior over domains. A document's
tokens count towards the domains by its posterior; nonnegative rates (expected copies of each document)
are fitted by projected-gradient least squares so that the expected tokens of the domains meet their
targets. The state of an iteration is a column; only the domains' sums come to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, space_words, table


def features(text: bytes | None, dims: int) -> np.ndarray:
    """Buckets of the distinct words, lower-cased and without punctuation at their ends, and of marks of form:
    a word in capitals, a word that ends in symbols, a word that follows itself."""
    words = space_words(text)
    crc = zlib.crc32
    plain = {w.strip(b".,;:!?\"'()[]").lower() for w in words}
    n = max(1, len(words))
    caps = sum(w.isupper() for w in words)
    odd = sum(not (w[-1:].isalnum() or w[-1:] in b".,;:!?" or w[-1] >= 128) for w in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = [b"\0%s%d" % (k, min(9, 10 * v // n)) for k, v in ((b"caps", caps), (b"odd", odd), (b"again", again))]
    return np.unique(np.array([crc(w) % dims for w in [*plain, *marks]], dtype=np.int64))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(sample: DataFrame, dims: int, epochs: int) -> tuple[list[str], np.ndarray]:
    """Multinomial logistic regression on rows ``text, domain`` in one task (the caller bounds them): domains, weights."""

    def fit(t: pa.Table) -> pa.Table:
        names, y = np.unique(np.array(t.column("domain").to_pylist()), return_inverse=True)
        rows = [features(x, dims) for x in t.column("t").to_pylist()]
        size = np.array([len(r) for r in rows])
        weight = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
        w, seen = np.zeros((dims + 1, len(names))), np.full((dims + 1, len(names)), 1e-8)
        edges = np.append(0, np.cumsum(size))
        flat = np.concatenate(rows)
        order = np.random.default_rng(0).permutation(len(rows))
        for epoch in range(epochs):
            for i in range(0, len(order), 256):  # AdaGrad on small batches
                pick = order[i : i + 256]
                at = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in pick])
                row = np.repeat(np.arange(len(pick)), size[pick])
                sums = lambda of, v, n: np.stack([np.bincount(of, x, n) for x in v.T], axis=1)
                gap = _softmax(sums(row, w[flat[at]] * weight[at][:, None], len(pick)) + w[dims])
                gap[np.arange(len(pick)), y[pick]] -= 1
                used, place = np.unique(flat[at], return_inverse=True)
                grad = np.vstack([sums(place, gap[row] * weight[at][:, None], len(used)), gap.sum(axis=0)])
                used = np.append(used, dims)
                grad = grad / len(pick) + 1e-6 * w[used]
                seen[used] += grad**2
                w[used] -= 0.5 * grad / np.sqrt(seen[used])
        return pa.table({"domain": pa.array(names.tolist(), pa.string()), "w": pa.array(list(w.T.astype(np.float32)), pa.list_(pa.float32()))})

    got = sample.select(F.col("text").cast("binary").alias("t"), "domain", F.lit(0).alias("all")).groupBy("all").applyInArrow(fit, "domain string, w array<float>").collect()
    got.sort(key=lambda r: r["domain"])
    return [r["domain"] for r in got], np.array([r["w"] for r in got], dtype=np.float32).T


def posteriors(docs: DataFrame, text: str, model: tuple[list[str], np.ndarray], dims: int):
    """A column: struct of tokens and the list of posteriors, in the model's order of domains."""
    sent = docs.sparkSession.sparkContext.broadcast(model[1])

    @F.arrow_udf("struct<tokens: long, p: array<double>>")
    def judge(texts: pa.Array) -> pa.Array:
        w, tokens, p = sent.value, [], []
        for t in texts.to_pylist():
            f = features(t, dims)
            tokens.append(len(space_words(t)))
            p.append(_softmax((w[f].sum(axis=0) / np.sqrt(max(1, len(f))) + w[dims])[None].astype(float))[0].tolist())
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["tokens", "p"])

    return judge(F.col(text).cast("binary"))


def _descended(gaps: list[list[float]], eta: float, pull: float):
    """A column function: the rate of a posterior after one projected step for each list of gaps."""
    history = np.array(gaps)

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        x, r = np.asarray(p.flatten()).reshape(len(p), -1), np.ones(len(p))
        for g in history:
            r = np.maximum(0.0, r - eta * (x @ g + pull * (r - 1)))
        return pa.array(r, pa.float64())

    return rate


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], total: float | None, steps: int, pull: float) -> tuple[DataFrame, list]:
    """``rows`` (with ``tokens, p``) and ``rate``; and each domain's (before, target, after).

    Minimises, over rates >= 0, the sum over domains of (expected tokens - target)^2 / (tokens at rate 1), plus
    ``pull`` times the token-weighted squared distance of the rates from 1, by projected gradient with step
    1 / (1 + pull), which cannot overshoot: scaled so, no direction is steeper than 1. A rate is a function of the
    domains' gaps in the steps before, a short list, so a step is one pass that returns a number a domain.
    """
    k = len(domains)
    sums = lambda rate: [r or 0.0 for r in rows.agg(*(F.sum(F.col("tokens") * F.col("p")[i] * rate) for i in range(k))).first()]
    before = sums(F.lit(1.0))
    whole = sum(targets.get(d, 0.0) for d in domains) or 1.0
    goal = [(total if total is not None else sum(before)) * targets.get(d, 0.0) / whole for d in domains]
    gaps, now, eta = [], before, 1 / (1 + pull)
    rate = F.lit(1.0)
    for _ in range(steps):
        gap = [(s - g) / b if b else 0.0 for s, g, b in zip(now, goal, before, strict=True)]
        if max(map(abs, gap), default=0.0) < 1e-4:
            break
        gaps.append(gap)
        rate = _descended(gaps, eta, pull)(F.col("p"))
        now = sums(rate)
    return rows.withColumn("rate", rate), list(zip(domains, before, goal, now, strict=True))


#: Share of the mixture's expected tokens by domain (quality and toxicity of the label table).
TARGETS = {"q1t0": 1.0, "q0t0": 0.02, "q1t1": 0.0, "q0t1": 0.0}


def labelled(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """``text, domain`` of at most about ``sample`` labelled ids, picked by a hash of the id, and at most ``sample_bytes`` of text.

    An id gives one text, the one with the least hash, however many rows hold it; an id with several labels has the first domain
    in order. Texts are taken in the order of their ids' hashes as long as the bytes of all up to them are within the bound.
    """
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain")
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").where(part).select("doc_id", domain)
    some = some.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    # the sample is bounded, so it can go to all tasks and the texts stay where they are
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    # copies and rows of one id meet in tasks first
    one = pinned(texts.groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's ids and sizes only
    within = one.select("doc_id", F.sum(F.octet_length("text")).over(order).alias("bytes")).where(F.col("bytes") <= sample_bytes)
    return one.join(F.broadcast(within.select("doc_id")), "doc_id").select("text", "domain")


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, learn_from: DataFrame | None = None,
    keep: list[str] | None = None, sample: int = 20_000, dims: int = 1 << 16, epochs: int = 4, steps: int = 40, pull: float = 0.01,
    sample_bytes: int = 1 << 28,
) -> tuple[DataFrame, list]:
    """``doc_id, tokens, domain, p (posterior by domain), rate`` for each row of ``docs``, and the domains' token sums.

    ``targets`` are the domains' shares of the expected tokens, ``total`` those tokens (default: as many as there are). The classifier is
    fitted on one text each of at most about ``sample`` labelled ids and at most ``sample_bytes`` of them (documented bounds); everything
    else covers all rows. A null or empty text has no tokens, the posterior of an empty document, and a rate like any other. Nothing labelled: one
    domain ``all`` and rates that meet the total. Null and repeated ids keep their rows; null labels are ignored.
    """
    pairs = labelled(docs if learn_from is None else learn_from, labels, sample, sample_bytes)
    domains, w = fit_classifier(pairs, dims, epochs)
    if not domains:
        domains, w, targets = ["all"], np.zeros((dims + 1, 1), np.float32), {"all": 1.0}
    names = keep or ["doc_id"]
    judged = docs.select(*(F.col(c) for c in names), F.col("text").alias("_text")).withColumn("_r", posteriors(docs, "_text", (domains, w), dims))
    rows = pinned(judged.select(*names, F.col("_r.tokens").alias("tokens"), F.col("_r.p").alias("p")), "posteriors")
    fitted, report = fit_rates(rows, domains, targets, total, steps, pull)
    best = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int"))
    return fitted.select(*names, "tokens", best.alias("domain"), F.map_from_arrays(F.array(*map(F.lit, domains)), "p").alias("p"), "rate"), report


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "tokens", "domain", F.element_at("p", F.col("domain")).alias("posterior"), "rate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, drawn at their rates: one stays if a hash of its id and text, spread over [0, 1), is below its rate.

    Rows equal in id and text share their rate and their draw; rows of one id, or without one, that differ in text are drawn
    apart. A rate above 1 keeps the document once: the stage before left one of each group of copies, and this one adds none.
    """
    rows, _ = mix(docs.withColumn("_th", F.xxhash64("text")), table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"), keep=["doc_id", "_th"])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "_th", F.lit("draw")), 11) / F.lit(float(1 << 53))
    keep = rows.where(draw < F.col("rate")).select(F.col("doc_id").alias("_keep"), F.col("_th").alias("_text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(keep["_keep"]) & (F.xxhash64(docs["text"]) == keep["_text_hash"])
    return docs.join(keep, same, "left_semi")
