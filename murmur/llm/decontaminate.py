"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). As a
set of shingles it is contained in a document only if *all* its shingles are, so any one of them is
a necessary prefix token: the join takes the rarest, counted over all documents. A shared token at
document position p and window offset o proposes the start p - o; the positional and length bounds
(0 <= start, start + length <= words of the document) and a word-by-word comparison decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, plain_words, table

#: Odd multipliers that mix word numbers into a shingle code (collisions only add candidates).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A code for each run of k word numbers."""
    code = ids[: len(ids) - k + 1].astype(np.uint64)
    for j in range(1, k):
        code = (code ^ (code >> np.uint64(29))) * MIX[0] + ids[j : len(ids) - k + 1 + j].astype(np.uint64) * MIX[1]
    return code


class _Block:
    """One block of benchmark windows: its words' numbers, and for each shingle length the codes."""

    def __init__(self, windows: list[tuple[bytes, ...]], shingle: int):
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for x in windows for w in x}))}
        self.length = np.array([len(x) for x in windows], dtype=np.int64)
        self.words = np.zeros((len(windows), max(map(len, windows), default=0)), dtype=np.int64)
        for i, x in enumerate(windows):
            self.words[i, : len(x)] = [self.number[w] for w in x]
        self.size = np.minimum(self.length, shingle)
        self.sizes = sorted({int(x) for x in self.size})
        self.codes = {
            k: [(int(i), _codes(self.words[i, : self.length[i]], k)) for i in np.flatnonzero(self.size == k)]
            for k in self.sizes
        }
        self.known = {k: np.unique(np.concatenate([c for _, c in v])) for k, v in self.codes.items()}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def shared(self, ids: np.ndarray, among: dict[int, np.ndarray]):
        """(shingle length, document positions, places in ``among``) of the codes that both have."""
        for k in self.sizes:
            if len(ids) < k or not len(among[k]):
                continue
            ok = ids[: len(ids) - k + 1] > 0
            for j in range(1, k):
                ok = ok & (ids[j : len(ids) - k + 1 + j] > 0)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            code = _codes(ids, k)[at]
            place = np.minimum(np.searchsorted(among[k], code), len(among[k]) - 1)
            same = among[k][place] == code
            if same.any():
                yield k, at[same], place[same]

    def choose(self, count: dict[tuple[int, int], int]) -> None:
        """The prefix token of each window: its rarest shingle (ties: the smaller code, then offset)."""
        self.prefix, self.lists = {}, {}
        for k, rows in self.codes.items():
            chosen = []
            for i, codes in rows:
                best = min(range(len(codes)), key=lambda o: (count.get((k, int(codes[o])), 0), int(codes[o]), o))
                if (k, int(codes[best])) in count:  # else it stands in no document at all
                    chosen.append((int(codes[best]), i, best))
            chosen.sort()
            keys, first = np.unique(np.array([c for c, _, _ in chosen], dtype=np.uint64), return_index=True)
            self.prefix[k] = keys
            self.lists[k] = (
                np.append(first, len(chosen)),
                np.array([i for _, i, _ in chosen], dtype=np.int64),
                np.array([o for _, _, o in chosen], dtype=np.int64),
            )

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all occurrences in a document."""
        starts, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, at, place in self.shared(ids, self.prefix):
            bounds, window, offset = self.lists[k]
            n = bounds[place + 1] - bounds[place]
            row = np.repeat(bounds[place] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            start, win = np.repeat(at, n) - offset[row], window[row]
            ok = (start >= 0) & (start + self.length[win] <= len(ids))  # positional and length bounds
            start, win = start[ok], win[ok]
            for j in range(self.words.shape[1]):  # exact: word by word
                ok = (j >= self.length[win]) | (ids[np.minimum(start + j, len(ids) - 1)] == self.words[win, j])
                start, win = start[ok], win[ok]
            starts.append(start)
            found.append(win)
        return np.concatenate(starts), np.concatenate(found)


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``(win array<binary>, item_id string)``: the distinct windows of each item."""

    def cut(batches):
        for b in batches:
            win, item = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = plain_words(t)
                for x in {tuple(words[j : j + window]) for j in range(max(1, len(words) - window + 1))} if words else ():
                    win.append(list(x))
                    item.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(win, pa.list_(pa.binary())), pa.array(item, pa.string())], names=["win", "item_id"]
            )

    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(cut, "win array<binary>, item_id string").distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shingle: int = 3,
    share: int = 20,
    block_windows: int = 200_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``.

    ``items`` is the sorted list of item ids; a document is contaminated if some word is hit and
    ``share * n_hit >= n_words``. Benchmark windows travel to the tasks in blocks of at most
    ``block_windows`` distinct windows (the proven bound of what is broadcast: about 40 MB), each
    joined with all documents in one pass for the counts of rarity and one for the join; a
    benchmark of any size is a number of such blocks. Documents are never shuffled when one block
    holds the benchmark; with more, the hits (not the texts) are grouped by document. ``keep`` names
    columns of ``docs`` to return in place of the id (they must not clash with the result's names).

    Nulls: a null text has no words and no hits; null ids are kept as they are, as is each of
    several rows with one id. An item with a null or wordless text has no window; a null item id
    hits words but stands in no list. Empty tables give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    wins = pinned(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    n_blocks = max(1, -(-wins.select("win").distinct().count() // block_windows))
    texts = docs.select(F.col(text).cast("binary").alias("t"))
    found = [_hits(spark.sparkContext.broadcast(_block(wins, i, n_blocks, shingle, texts))) for i in range(n_blocks)]
    t = F.col(text).cast("binary")
    if n_blocks == 1:
        rows = docs.withColumn("_r", found[0](t))
    else:  # the hits of each block, not the texts, are written and joined by row
        keyed = docs.withColumn("_k", F.struct(F.col(doc_id).alias("i"), F.xxhash64(text).alias("x")))
        parts = None
        for f in found:
            part = pinned(keyed.select("_k", f(t).alias("_r")).dropDuplicates(["_k"]), "hits")
            parts = part if parts is None else parts.unionByName(part)
        rows = keyed.join(parts.groupBy("_k").agg(_merged().alias("_r")), "_k").drop("_k")
    n_hit, n_words = F.col("_r.n_hit"), F.col("_r.n_words")
    return rows.select(
        *(docs[c] for c in keep) if keep is not None else [F.col(doc_id).alias("doc_id")],
        "_r.n_words", "_r.n_hit", "_r.n_items", "_r.items_sha256",
        ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"), "_r.items",
    )


def _block(wins: DataFrame, i: int, n: int, shingle: int, texts: DataFrame):
    """The i-th block with its prefix tokens, and the item ids of each window."""
    rows = wins.where(F.pmod(F.hash(F.to_json("win")), F.lit(n)) == i) if n > 1 else wins
    items: dict[tuple[bytes, ...], set] = {}
    for r in rows.toLocalIterator():
        items.setdefault(tuple(bytes(w) for w in r["win"]), set()).add(r["item_id"])
    windows = sorted(items)
    block = _Block(windows, shingle)
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        for b in batches:
            own, got = sent.value, {}
            for t in b.column(0).to_pylist():
                for k, _, place in own.shared(own.ids(plain_words(t)), own.known):
                    got.setdefault(k, []).append(place)
            for k, places in got.items():
                place, c = np.unique(np.concatenate(places), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(c), k, np.int32)), pa.array(place.astype(np.int64)), pa.array(c.astype(np.int64))],
                    names=["k", "place", "c"],
                )

    # at most as many rows as the block has shingles, so within the block's bound
    rows = texts.mapInArrow(count, "k int, place long, c long").groupBy("k", "place").agg(F.sum("c").alias("c"))
    block.choose({(r["k"], int(block.known[r["k"]][r["place"]])): r["c"] for r in rows.collect()})
    block.items = [sorted(x for x in items[w] if x is not None) for w in windows]
    del block.codes, block.known
    return block


KIND = "struct<n_words: long, n_hit: long, n_items: long, items_sha256: string, items: array<string>, hits: array<long>>"


def _hits(sent):
    """A function of a binary text column: the struct ``KIND`` for one block of windows."""

    @F.arrow_udf(KIND)
    def find(texts: pa.Array) -> pa.Array:
        block, out = sent.value, []
        for t in texts.to_pylist():
            words = plain_words(t)
            start, win = block.find(block.ids(words))
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(marks, start, 1)
            np.add.at(marks, start + block.length[win], -1)
            covered = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            items = sorted({x for w in np.unique(win) for x in block.items[w]})
            out.append((len(words), len(covered), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), items, covered.tolist()))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        names = ["n_words", "n_hit", "n_items", "items_sha256", "items", "hits"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return find


def _merged():
    """The struct of all blocks together: words hit by any of them, items of all."""
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_r.items"))))
    hits = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_r.hits"))))
    return F.struct(
        F.first("_r.n_words").alias("n_words"), F.size(hits).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), items.alias("items"), hits.alias("hits"),
    )


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, whole; one pass, no shuffle of texts."""
    marked = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)), F.col("text").alias("_t"), F.col("doc_id").alias("_id"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    found = decontaminate(marked, table(spark, sf_dir, "benchmark"), "_id", "_t", keep=names)
    return found.where(~F.col("contaminated")).select(*(F.col(x).alias(c) for x, c in zip(names, docs.columns, strict=True)))


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPLIT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT}, []) w FROM documents),
i AS (SELECT item_id, {_SPLIT} w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM g JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
