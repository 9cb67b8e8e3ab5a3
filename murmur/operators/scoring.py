"""Pluggable batch model scoring.

A *scorer factory* is a zero-argument callable returning a batch scorer, or ``None`` when
the model is unavailable. It is called once per Python worker (the model is built next to the
data, never on the driver, and kept for the worker's later tasks); a failing load fails the task:

* class-probability scorer: ``list[str] -> list[dict[label, prob]]``; the item score is
  p(positive) - p(negative) (D3), averaged over the text's chunks;
* label scorer (irony): ``list[str] -> list[dict(label=str, score=float)]``.

Only key columns and the text cross into Python (Arrow batches); results come back as
key + score and everything else stays in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from murmur import config
from murmur.functions.text import chunk_array
from murmur.operators.partitioning import spread
from murmur.session import ship_package

ScorerFactory = Callable[[], Callable | None]


def neutral_factory() -> None:
    """The offline model: unavailable, so every score is neutral (0 / UNKNOWN)."""
    return None


def letter_factory():
    """A small deterministic scorer for checks: the shares of the letters e (positive) and o (negative) in a text;
    the label says which is larger. SQL can compute the same."""
    def score(texts: list[str]) -> list[dict]:
        shares = [(t.count("e") / max(1, len(t)), t.count("o") / max(1, len(t))) for t in texts]
        return [{"positive": e, "negative": o, "label": "IRONIC" if o > e else "PLAIN", "score": max(e, o)} for e, o in shares]
    return score


#: Models of this Python worker by the digest of their factory, the one used longest ago first. A worker serves many tasks
#: one after another, so a model is loaded once per worker and factory, not once per task.
_LOADED: dict[str, Callable] = {}
MODELS_KEPT = 4


def _keyed(factory: ScorerFactory | None):
    """On the driver: what a task needs to find or load the model. Factories that pickle alike are the same model."""
    return None if factory is None else (hashlib.sha256(cloudpickle.dumps(factory)).hexdigest(), factory)


def _load(keyed):
    """In a task: the worker's model, or None where none was asked for. An error of a factory or a model fails the task
    (and is not kept: the next task tries again): a score that could not be made is never returned as a neutral one."""
    if keyed is None:
        return None
    key, factory = keyed
    model = _LOADED.pop(key, None) or factory()
    while len(_LOADED) >= MODELS_KEPT:
        _LOADED.pop(next(iter(_LOADED)))
    _LOADED[key] = model
    return model


def probability_scores(df: DataFrame, key_cols: list[str], text_col: str, factory: ScorerFactory | None,
                       out_col: str = "model_score", batch_size: int = config.SCORER_BATCH) -> DataFrame:
    """One score per row: p(positive) - p(negative) from the injected model; 0.0 when
    no model was asked for. A failing model fails the task."""
    src = df.select(*key_cols, text_col)
    src = spread(src)
    schema = T.StructType([src.schema[k] for k in key_cols] + [T.StructField(out_col, T.DoubleType())])
    wanted = _keyed(factory)

    def run(batches):
        model = _load(wanted)
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            scores = np.zeros(len(texts))
            if model is not None:
                for i in range(0, len(texts), batch_size):
                    res = model(texts[i:i + batch_size])
                    scores[i:i + batch_size] = [
                        float(r.get("positive", 0.0)) - float(r.get("negative", 0.0))
                        for r in ({str(k).lower(): v for k, v in d.items()} for d in res)]
            yield pdf[key_cols].assign(**{out_col: scores})

    ship_package(df.sparkSession)
    return src.mapInPandas(run, schema)


def daily_model_scores(chunks: DataFrame, factory: ScorerFactory | None, date_col: str = "date",
                       out_col: str = "finbert_sentiment") -> DataFrame:
    """T4: score every chunk of every day, then average the chunk scores per day (D3)."""
    s = probability_scores(chunks, [date_col, "chunk"], "text", factory, "_cs")
    return s.groupBy(date_col).agg(F.avg("_cs").alias(out_col), F.count(F.lit(1)).alias("chunks"))


def item_model_scores(items: DataFrame, factory: ScorerFactory | None, key_cols=("item_id",),
                      text_col: str = "text", chunk_chars: int = config.CHUNK_CHARS,
                      out_col: str = "finbert") -> DataFrame:
    """T5: row-level model score; long texts are cut into chunks (F5) and averaged."""
    key_cols = list(key_cols)
    ch = items.select(*key_cols, F.posexplode(chunk_array(text_col, chunk_chars)).alias("_k", "_chunk"))
    s = probability_scores(ch, key_cols + ["_k"], "_chunk", factory, "_cs")
    return s.groupBy(*key_cols).agg(F.avg("_cs").alias(out_col))


def irony_scores(df: DataFrame, key_cols: list[str], text_col: str, factory: ScorerFactory | None,
                 batch_size: int = config.SCORER_BATCH) -> DataFrame:
    """``(keys, sarcasm_label, sarcasm_score)``; ('UNKNOWN', 0.0) when no model was asked for."""
    src = df.select(*key_cols, F.col(text_col).alias("_text"))
    src = spread(src)
    schema = T.StructType([src.schema[k] for k in key_cols] + [
        T.StructField("sarcasm_label", T.StringType()), T.StructField("sarcasm_score", T.DoubleType())])
    wanted = _keyed(factory)

    def run(batches):
        model = _load(wanted)
        for pdf in batches:
            texts = pdf["_text"].fillna("").astype(str).tolist()
            labels = ["UNKNOWN"] * len(texts)
            scores = np.zeros(len(texts))
            if model is not None:
                for i in range(0, len(texts), batch_size):
                    res = model(texts[i:i + batch_size])
                    labels[i:i + batch_size] = [str(r["label"]) for r in res]
                    scores[i:i + batch_size] = [float(r["score"]) for r in res]
            yield pdf[key_cols].assign(sarcasm_label=labels, sarcasm_score=scores)

    ship_package(df.sparkSession)
    return src.mapInPandas(run, schema)


def rescored(df: DataFrame, text_col: str, model: ScorerFactory | None, irony: ScorerFactory | None,
             chunk_chars: int = config.CHUNK_CHARS, batch_size: int = config.SCORER_BATCH) -> DataFrame:
    """T5 and T6 of each row in one pass: ``df``'s columns (of the same names the old ones go) and
    ``finbert, sarcasm_label, sarcasm_score``. Rows need no key: null and repeated ids keep their rows."""
    names = ["finbert", "sarcasm_label", "sarcasm_score"]
    src = df.drop(*names)
    schema = T.StructType([*src.schema.fields, T.StructField(names[0], T.DoubleType()),
                           T.StructField(names[1], T.StringType()), T.StructField(names[2], T.DoubleType())])

    wanted = _keyed(model), _keyed(irony)

    def run(batches):
        score, judge = (_load(w) for w in wanted)
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            mean, labels, sure = np.zeros(len(texts)), ["UNKNOWN"] * len(texts), np.zeros(len(texts))
            if score is not None:
                of, parts = [], []
                for i, t in enumerate(texts):
                    cut = [t[j:j + chunk_chars] for j in range(0, len(t), chunk_chars)] or [""]
                    of += [i] * len(cut)
                    parts += cut
                got = []
                for i in range(0, len(parts), batch_size):
                    got += [{str(k).lower(): v for k, v in d.items()} for d in score(parts[i:i + batch_size])]
                each = np.array([float(r.get("positive", 0.0)) - float(r.get("negative", 0.0)) for r in got])
                mean = np.bincount(of, each, len(texts)) / np.bincount(of, minlength=len(texts))
            if judge is not None:
                for i in range(0, len(texts), batch_size):
                    res = judge(texts[i:i + batch_size])
                    labels[i:i + batch_size] = [str(r["label"]) for r in res]
                    sure[i:i + batch_size] = [float(r["score"]) for r in res]
            yield pdf.assign(**dict(zip(names, (mean, labels, sure), strict=True)))

    ship_package(df.sparkSession)
    return src.mapInPandas(run, schema)
