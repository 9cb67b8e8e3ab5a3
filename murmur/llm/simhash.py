"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most
3 bits, one segment differs in at most one. Each segment is indexed under its 32 variants with one bit
taken out (a wildcard): segments that are equal or differ in that bit share the variant's key. An
equality join on these keys gives all candidates; the Hamming distance of the whole decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, space_words, table
from .components import components

SEED = 42


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """The SimHash of the word shingles, repeats included: a bit is 1 if set in over half the hashes."""
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n
    )
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with a column ``_fp`` (bigint with the bits of the unsigned fingerprint)."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        out = [fingerprint(space_words(t and t.lower()), shingle) for t in texts.to_pylist()]
        return pa.array(np.array(out, dtype=np.uint64).view(np.int64))

    return docs.withColumn("_fp", fp(F.col(text).cast("binary")))


def _linked(fps: np.ndarray, distance: int) -> tuple[list, list]:
    """A spanning forest of the links among distinct fingerprints: (roots, members). Linear memory."""
    roots, members, rest = [], [], fps
    while len(rest) > 1:
        root, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            step = max(1, 2_000_000 // len(rest))
            for i in range(0, len(front), step):
                hit |= (np.bitwise_count(rest[:, None] ^ front[None, i : i + step]) <= distance).any(axis=1)
            front, rest = rest[hit], rest[~hit]
            roots += [root] * len(front)
            members += front.tolist()
    return roots, members


def _join(keys: DataFrame, distance: int, limit: int | None) -> DataFrame:
    """``(a, b, key)``: links in groups of equal ``key``; a group over ``limit`` rows comes out as it is (b null).

    ``keys`` is hash-partitioned and sorted by key, so a group is a run of rows; only the open group
    is held, and with a limit no more than ``limit`` of its rows.
    """

    def runs(batches):
        kept_k, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        over = None  # the key of an oversize group whose rows pass through
        for b in _with_end(batches):
            a_out, b_out, k_out = [], [], []
            if b is not None:
                kept_k = np.concatenate([kept_k, b.column(0).to_numpy()])
                kept_f = np.concatenate([kept_f, b.column(1).to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(kept_k == kept_k[-1], True)) if len(kept_k) else 0  # the open group stays
                if limit and len(kept_k) - cut > limit:
                    cut = len(kept_k)
            else:
                cut = len(kept_k)
            k, f, kept_k, kept_f = kept_k[:cut], kept_f[:cut], kept_k[cut:], kept_f[cut:]
            if len(k):
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                size = np.diff(np.append(first, len(k)))
                two = first[size == 2]
                near = np.bitwise_count(f[two] ^ f[two + 1]) <= distance
                if over is not None:
                    near &= k[two] != over
                a_out += f[two][near].tolist()
                b_out += f[two + 1][near].tolist()
                k_out += k[two][near].tolist()
                many = np.flatnonzero((size > 2) | (k[first] == (over if over is not None else k[0] - 1)))
                for i, n in zip(first[many].tolist(), size[many].tolist(), strict=True):
                    if limit and (n > limit or k[i] == over):
                        over = k[i]
                        a_out += f[i : i + n].tolist()
                        b_out += [None] * n
                        k_out += [int(k[i])] * n
                    elif n > 2:
                        x, y = _linked(f[i : i + n], distance)
                        a_out += x
                        b_out += y
                        k_out += [int(k[i])] * len(x)
            signed = lambda v: pa.array([None if x is None else int(x) - (int(x) >> 63 << 64) for x in v], pa.int64())
            yield pa.RecordBatch.from_arrays([signed(a_out), signed(b_out), pa.array(k_out, pa.int64())], names=["a", "b", "key"])

    return keys.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(runs, "a long, b long, key long")


def _with_end(batches):
    yield from batches
    yield None


def _variants(fp, segment, bits: int, shift):
    """Keys of a segment with one bit taken out, the bit's place beside it."""
    places = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.transform(places, lambda j: shift(segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))), j))


def links(distinct: DataFrame, distance: int = 3, limit: int = 4096) -> DataFrame:
    """``(a, b)`` edges that connect all fingerprints (column ``fp``, distinct) at ``distance`` or fewer bits, 3 at most.

    Within a group that shares a key, a spanning forest of the verified links is returned, not all
    pairs. A key with over ``limit`` fingerprints is not searched whole: its rows are keyed again by
    the one-wildcard variants of the *other* 32 bits, cut into two segments of 16 (they too
    differ by at most 3 bits, so one of the two by at most one). Such a group shares 46 bits, so it
    has at most 2^18 fingerprints (2 MB): a bound that holds at any corpus size.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    pack = lambda s: lambda v, j: F.shiftleft(v, 6) + F.lit(32 * s) + j
    keys = F.concat(_variants(fp, low, 32, pack(0)), _variants(fp, high, 32, pack(1)))
    first = pinned(_join(distinct.select("fp", F.explode(keys).alias("key")), distance, limit), "links")
    found = first.where("b IS NOT NULL").select("a", "b")
    if first.where("b IS NULL").isEmpty():
        return found
    other = F.when(F.col("key").bitwiseAND(F.lit(32)) == 0, high).otherwise(low)
    halves = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]
    again = first.where("b IS NULL").select(F.col("a").alias("fp"), "key")
    deep = F.concat(*(_variants(fp, half, 16, lambda v, j, s=s: F.xxhash64("key", F.lit(s), j, v)) for s, half in enumerate(halves)))
    more = _join(again.select("fp", F.explode(deep).alias("key")), distance, None)
    return found.unionByName(more.select("a", "b"))


def _labelled(docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int, *extra: Column) -> DataFrame:
    """``doc_id, extra, fp, component_id, part``: as ``simhash_components``, and the fingerprint that names the component."""
    rows = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), *extra, F.col(text).alias("t")), "t", shingle)
    rows = pinned(rows.drop("t").withColumnRenamed("_fp", "fp"), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(own.select("fp"), distance), "a", "b", "simhash")
    linked = found.withColumnRenamed("node", "fp").join(own, "fp", "left")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    known = linked.join(roots, "root").select("fp", "root", "component")
    label = own.join(known, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("part"))
    return rows.join(label, "fp")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document row: ``doc_id, fp, component_id`` (smallest doc_id of the fingerprints linked by chains).

    Copies share a fingerprint and count once in the join. A null, empty or wordless text has
    fingerprint zero, linked like any other. Null ids are kept; they never name a component unless
    all its ids are null. Repeated rows each get a row.
    """
    return _labelled(docs, doc_id, text, shingle, distance).select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, whole: the smallest id (of equal ids, the least hash of the text). Null ids
    come last, so one stays only in a component of null ids. Of rows equal in id and text, one stays.
    """
    rows = _labelled(docs, "doc_id", "text", 3, 3, F.xxhash64("text").alias("th"))
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    keep = least.select(F.col("k.doc_id").alias("_keep"), F.col("k.th").alias("_kept"))
    own = docs.withColumn("_th", F.xxhash64("text"))
    kept = own.join(keep, own["doc_id"].eqNullSafe(keep["_keep"]) & (own["_th"] == keep["_kept"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_th"]).drop("_th")
