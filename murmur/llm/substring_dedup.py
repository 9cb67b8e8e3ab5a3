"""Substring dedup with compressed FM-indexes.

Work is dealt so that equal passages meet in one shard. In each window of ``window`` words the anchor
is the run of ``anchor`` words with the least hash; it depends on the window's words only, so equal
windows have equal anchors. Consecutive windows with one anchor form a segment. Only segments whose
anchor occurs twice or more anywhere can hold a repeated window (the others leave at the first count);
of equal segments one stands for all, with their number.

Each shard builds an FM-index of its segments, as numbered blocks of words in each phase, so that a
window is a few symbols: Burrows-Wheeler transform, symbol starts, and a wavelet matrix of
bit-packed levels with block ranks. The segments are streamed through it: backward search of all
positions at once gives their matching statistics up to the threshold, weighted by the segments'
numbers, and the intervals of positions whose whole window stands in two places or more are reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, space_words, table

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BYTE, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, n - 1).bit_length()
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(values: np.ndarray, base: int, start, end) -> np.ndarray:
    """Hashes of values[start:end], from running sums."""
    power, inverse = _powers(base, len(values) + 1)
    total = np.append(np.uint64(0), np.cumsum(values * power[: len(values)], dtype=np.uint64))
    return _mix((total[end] - total[start]) * inverse[start])


def word_hashes(words: list[bytes], step: int = 20_000) -> np.ndarray:
    """A 64-bit hash of each word; a bounded number of words at a time."""
    out = []
    for i in range(0, len(words), step):
        part = words[i : i + step]
        raw = np.frombuffer(b"".join(part), np.uint8).astype(np.uint64) + np.uint64(1)
        end = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
        start = np.append(0, end[:-1])
        out.append(_spans(raw, BYTE, start, end))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def segments(words: list[bytes], window: int, anchor: int):
    """``(start, windows, anchor hash, segment hash)`` arrays of a document's segments."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    h = word_hashes(words)
    at = np.arange(len(words) - anchor + 1)
    grams = _spans(h, WORD, at, at + anchor)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
    low = np.concatenate([view[i : i + 100_000].argmin(axis=1) for i in range(0, n, 100_000)]) + np.arange(n)
    start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    size = np.diff(np.append(start, n))
    whole = _spans(h, WORD, start, start + size + window - 1) ^ (size.astype(np.uint64) * np.uint64(BYTE))
    return start, size, grams[low[start]], whole


# ---------------------------------------------------------------- FM-index


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b), in their order."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _runs(symbols: np.ndarray, length: int) -> np.ndarray:
    """Ranks of symbols[i:i+length] at each i (cut short at the end, which counts as 0s)."""
    rank, have = symbols, 1
    shift = lambda x, k: np.append(x[k:], np.zeros(min(k, len(x)), x.dtype))
    while have < length:
        step = min(have, length - have)
        rank = _pair(rank, shift(rank + 1, step))
        have += step
    return rank


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bit-packed level for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.bits = [], max(1, int(largest).bit_length())
        now = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (now >> k) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))[:-1].astype(np.int32)
            zeros = len(now) - int(bit.sum())
            self.levels.append((packed, before, zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.starts = self._walk(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, before, zeros) in enumerate(self.levels):
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[at >> 6] + np.bitwise_count(packed[at >> 6] & mask)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at``."""
        return self._walk(symbol, at) - self.starts[symbol]


class FMIndex:
    """Counts patterns of up to ``depth`` symbols; each suffix has a weight."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        order = np.argsort(_runs(text, depth), kind="stable")  # suffixes sorted as deep as patterns go
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1)))
        self.bwt = WaveletMatrix(text[order - 1], int(text.max(initial=0)))
        self.weight = np.append(0, np.cumsum(weight[order]))

    def at_least(self, patterns: np.ndarray, least: int) -> np.ndarray:
        """Whether each row's pattern has at least that weight; backward search from the last symbol."""
        row, last = np.arange(len(patterns)), patterns[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for step in range(patterns.shape[1] - 2, -1, -1):
            alive = self.weight[hi] - self.weight[lo] >= least  # matches of the rest fall below: the search ends
            row, lo, hi = row[alive], lo[alive], hi[alive]
            c = patterns[row, step]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        out = np.zeros(len(patterns), dtype=bool)
        out[row[self.weight[hi] - self.weight[lo] >= least]] = True
        return out


def repeated(rows: list[list[bytes]], copies: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """``(row, from, to)``: the intervals of positions in each row whose window occurs twice or more, by copies."""
    block = max(b for b in range(1, min(window, 7) + 1) if window % b == 0)
    depth = window // block
    size = np.array([len(r) for r in rows])
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for r in rows for w in r], dtype=np.int64)
    blocks = _runs(ids, block)
    row = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(ids)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
    inside = np.flatnonzero(at + block <= size[row])  # blocks that end in their own row
    order = inside[np.lexsort((at[inside], at[inside] % block, row[inside]))]  # row, phase, position
    ends = np.append((row[order][1:] != row[order][:-1]) | (at[order][1:] != at[order][:-1] + block), True)
    place = np.arange(len(order)) + np.append(0, np.cumsum(ends)[:-1])
    text = np.zeros(len(order) + int(ends.sum()), dtype=np.int64)  # 0 closes a phase
    used, symbol = np.unique(blocks[order], return_inverse=True)
    text[place] = symbol + 1
    weight = np.zeros(len(text), dtype=np.int64)
    weight[place] = copies[row[order]]
    index = FMIndex(text, weight, depth)
    of = np.zeros(len(ids), dtype=np.int64)
    of[order] = symbol + 1
    out = []
    starts = np.flatnonzero(at + window <= size[row])
    for i in range(0, len(starts), 1 << 18):
        p = starts[i : i + (1 << 18)]
        hit = p[index.at_least(of[p[:, None] + block * np.arange(depth)], 2)]
        out.append(hit)
    hit = np.concatenate(out) if out else np.empty(0, np.int64)
    if not len(hit):
        return []
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]))
    a = hit[new]
    n = np.diff(np.append(np.flatnonzero(new), len(hit)))
    return list(zip(row[a].tolist(), at[a].tolist(), (at[a] + n).tolist(), strict=True))


# ---------------------------------------------------------------- Spark


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_segments(window: int, anchor: int):
    def find(batches):
        for b in batches:
            parts, docs = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                p = segments(space_words(t), window, anchor)
                if len(p[0]):
                    parts.append(p)
                    docs.append(np.full(len(p[0]), i))
            if not parts:
                continue
            s, n, a, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = pa.array(np.concatenate(docs))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column(1).take(of), pa.array(s), pa.array(n), _signed(a), _signed(h)],
                names=["doc_id", "th", "s", "n", "ah", "sh"],
            )

    return find


def _cut_segments(window: int):
    def cut(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for t, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = space_words(t)
                for g in segs:
                    s, n = g["s"], g["n"]
                    if g["hot"]:
                        for j in range(n):
                            line = b" ".join(words[s + j : s + j + window])
                            for x, v in zip(out, (xxhash.xxh64_intdigest(line) >> 1, g["ah"], g["sh"], j, g["mult"], line, True), strict=True):
                                x.append(v)
                    else:
                        line = b" ".join(words[s : s + n + window - 1])
                        for x, v in zip(out, (g["ah"], g["ah"], g["sh"], 0, g["mult"], line, False), strict=True):
                            x.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["k", "ah", "sh", "off", "mult", "words", "hot"])

    return cut


def _search_shard(window: int):
    def search(t: pa.Table) -> pa.Table:
        ah, sh, off, mult = (t.column(c).to_numpy() for c in ("ah", "sh", "off", "mult"))
        order = np.lexsort((off, sh, ah))  # a replayed batch may send a segment more than once
        one = order[np.append(True, (np.diff(ah[order]) != 0) | (np.diff(sh[order]) != 0) | (np.diff(off[order]) != 0))]
        words = t.column("words").take(pa.array(one)).to_pylist()
        found = repeated([w.split() for w in words], mult[one], window)
        r, a, z = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        r = one[r] if len(r) else r
        return pa.table({"ah": ah[r], "sh": sh[r], "a": a + off[r], "z": z + off[r], "hot": t.column("hot").take(pa.array(r))})

    return search


def _remove(window: int, with_text: bool):
    def remove(batches):
        for b in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = space_words(t)
                marks = np.zeros(len(words) + 1, dtype=np.int64)
                for x in spans or ():
                    marks[x["a"]] += 1
                    marks[x["z"] + window - 1] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept if with_text else None)
            cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return remove


def substring_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 35,
    anchor: int = 12,
    shard_words: int = 500_000,
    hot_segments: int = 5_000,
    with_text: bool = False,
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_removed, kept_sha256, kept`` (the kept words; null unless asked for).

    A word goes if it lies in a window of ``window`` words that starts in two places or more, all
    judged on the input; every occurrence goes. An anchor with more than ``hot_segments`` different
    segments is no single group: its segments are cut into windows; equal windows are summed (within tasks first) into one
    with their number, which is dealt by its own words, so a shard holds about ``shard_words`` words whatever is common.

    Null texts have no words and keep nothing (SHA-256 of the empty text). Null ids, repeated ids
    and repeated rows each keep their row; rows that are equal throughout repeat each other.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t"))
    every = rows.mapInArrow(_find_segments(window, anchor), f"doc_id {kind}, th long, s long, n long, ah long, sh long")
    shared = every.groupBy("ah").agg(F.count("*").alias("c")).where("c > 1").select("ah")
    occ = pinned(every.join(shared, "ah"), "segments")
    one = occ.groupBy("ah", "sh").agg(F.min(F.struct("doc_id", "th", "s", "n")).alias("r"), F.count("*").alias("mult"))
    one = pinned(one.select("ah", "sh", "mult", "r.*"), "distinct")
    hot = one.groupBy("ah").agg(F.count("*").alias("c")).where(F.col("c") > hot_segments).select("ah", F.lit(True).alias("hot"))
    marked = one.join(hot, "ah", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # rows equal in id and text are one text here, however many they are; the key is never null, so grouping and join share a shuffle
    key = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("")).alias("dk")
    by_doc = marked.groupBy(key, "th").agg(F.collect_list(F.struct("s", "n", "ah", "sh", "mult", "hot")).alias("segs"))
    texts = rows.groupBy(key, "th").agg(F.first("t").alias("t"))
    cut = texts.join(by_doc, ["dk", "th"]).select("t", "segs").mapInArrow(_cut_segments(window), "k long, ah long, sh long, off long, mult long, words binary, hot boolean")
    words = marked.agg(F.sum(F.when(F.col("hot"), F.col("n") * window).otherwise(F.col("n") + window - 1))).first()[0] or 0
    shard = F.pmod(F.xxhash64("k"), F.lit(max(1, -(-words // shard_words)))).alias("shard")
    # each place counts once, then equal windows become one row
    places = cut.where("hot").groupBy("k", "words", "ah", "sh", "off").agg(F.max("mult").alias("mult"))
    places = pinned(places.withColumn("wh", F.xxhash64("words")), "windows")
    summed = places.groupBy("k", "words", "wh").agg(F.sum("mult").alias("mult"))
    summed = summed.select("k", F.col("k").alias("ah"), F.col("wh").alias("sh"), F.lit(0).cast("long").alias("off"), "mult", "words", F.lit(True).alias("hot"))
    dealt = cut.where("NOT hot").unionByName(summed)
    found = dealt.select("*", shard).groupBy("shard").applyInArrow(_search_shard(window), "ah long, sh long, a long, z long, hot boolean")
    found = pinned(found, "found")
    again = found.where("hot").select(F.col("ah").alias("k"), F.col("sh").alias("wh"))
    again = places.join(again, ["k", "wh"]).select("ah", "sh", F.col("off").alias("a"), (F.col("off") + 1).alias("z"))
    found = found.where("NOT hot").drop("hot").unionByName(again)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    spans = occ.join(found, ["ah", "sh"]).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(
        F.collect_set(F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("z")).alias("z"))).alias("spans")
    )
    out = rows.join(spans, same, "left").select("doc_id", "t", "spans")
    return out.mapInArrow(_remove(window, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) s FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) p FROM g SEMI JOIN r USING (g)),
k AS (SELECT doc_id, w, list(p) ps FROM d LEFT JOIN gone USING (doc_id) GROUP BY doc_id, w)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(len(list_filter(ps, lambda x: x IS NOT NULL)), 0)::BIGINT n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ')) kept_sha256 FROM k
"""
