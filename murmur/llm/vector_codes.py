"""Vector code compression: product codes whose nearest entries are found by an integer Walsh-Hadamard transform.

A vector's components become integers and are cut into ``PARTS`` consecutive parts, each coded by the number of its
nearest codebook entry. Parts and entries are zero-padded to a power of two and transformed; the transform keeps
squared distances but for the factor of the padded length, so squared differences of the coefficients, summed in
sequency order (slow changes first), are growing lower bounds of the scaled distance. An entry whose sum passes the
whole distance of the entry that led after the first coefficients is dropped. All of it is whole-number arithmetic.

Each pass runs over the stored integer vectors; what tasks send on is one sum for each part, entry and position, and
what the driver and the tasks hold is the codebooks: ``ENTRIES`` times the vector length numbers, whatever the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_size, pinned, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Coefficients that are summed before entries are compared with the bound, and vectors compared at once.
STEP, CHUNK = 4, 2048


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def sequency(m: int) -> np.ndarray:
    """Row numbers of the transform (``m`` a power of two) by their number of sign changes."""
    bits, s = m.bit_length() - 1, np.arange(m)
    gray, out = s ^ (s >> 1), np.zeros(m, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer transform of the last axis, zero-padded to a power of two, coefficients in sequency order."""
    m = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], m), np.int64)
    y[..., : x.shape[-1]] = x
    h = 1
    while h < m:
        y = y.reshape(*x.shape[:-1], m // (2 * h), 2, h)
        y = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(*x.shape[:-1], m)
        h *= 2
    return y[..., sequency(m)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each transformed part the number of its nearest transformed entry (the lowest of equal ones) and the
    scaled squared distance."""
    m = x.shape[1]
    sums = np.zeros((len(x), len(book)), np.int64)
    for c in range(min(STEP, m)):
        d = x[:, c, None] - book[None, :, c]
        sums += d * d
    bound = ((x - book[sums.argmin(1)]) ** 2).sum(1)
    r, e = np.nonzero(sums <= bound[:, None])  # by vector, then by entry
    sums = sums[r, e]
    for c in range(STEP, m, STEP):
        d = x[r, c : c + STEP] - book[e, c : c + STEP]
        sums += np.einsum("ij,ij->i", d, d)
        left = sums <= bound[r]
        r, e, sums = r[left], e[left], sums[left]
    first = np.flatnonzero(np.diff(r, prepend=-1))  # the leader itself is always left
    best = np.minimum.reduceat(sums, first) if len(r) else sums
    ties = np.flatnonzero(sums == best[r])
    return e[ties[np.flatnonzero(np.diff(r[ties], prepend=-1))]], best


def _codes(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and exact squared distances, one column a part, of whole vectors."""
    x, w = walsh(vectors.reshape(len(vectors), *books.shape[::2])), walsh(books)
    codes, errors = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for i in range(0, len(x), CHUNK):
        for p in range(x.shape[1]):
            codes[i : i + CHUNK, p], errors[i : i + CHUNK, p] = nearest(x[i : i + CHUNK, p], w[p])
    return codes, errors // x.shape[2]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def vectors(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable vector, ``vector`` in integers, stored, and the length of all. Shorter vectors are filled with zeros up to
    the longest, and that to a multiple of ``PARTS``."""
    kept = pinned(rows.where(usable(F.col(vector))).withColumn(vector, integers(F.col(vector))), "vectors")
    top = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    longest, largest = kept.agg(F.max(F.size(vector)), F.max(top)).first()
    length = -(-max(longest or 0, 1) // PARTS)
    m = 1 << (length - 1).bit_length()
    if 4 * m**3 * (largest or 0) ** 2 >= 2**63:
        raise ValueError(f"components up to {largest} in parts of {length} are beyond exact 64-bit distances")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(length * PARTS) - F.size(vector))
    return kept.withColumn(vector, F.concat(vector, zeros)), length * PARTS


def train(kept: DataFrame, width: int, order: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) after ``rounds`` passes over all rows; they start as the ``ENTRIES`` smallest rows
    by ``order`` (nulls last, equal ones by vector). None for an empty table."""
    first = [r[0] for r in kept.orderBy(F.col(order).asc_nulls_last(), vector).limit(ENTRIES).select(vector).collect()]
    if not first:
        return None
    books = np.array(first, np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()

    def sums_of(books):
        def run(batches):
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                x = _matrix(b.column(0), width)
                codes, _ = _codes(x, books)
                x = x.reshape(len(x), books.shape[0], books.shape[2])
                for p in range(books.shape[0]):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        return run

    for _ in range(rounds):
        sums = kept.select(vector).mapInArrow(sums_of(books), "part long, entry long, n long, sums array<long>")
        each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        new = each.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        books = books.copy()
        for r in new.collect():  # at most as many rows as the codebooks have numbers
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return books


def encode(kept: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``kept`` with ``codes`` (entry numbers, one a part) and ``error`` (squared distance of the vector to its entries) in place of the vector."""
    names = [c for c in kept.columns if c not in (vector, "codes", "error")]
    width = books.shape[0] * books.shape[2]

    def run(batches):
        for b in batches:
            codes, errors = _codes(_matrix(b.column(len(names)), width), books)
            out = [*b.columns[: len(names)], pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors.sum(1))]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "codes", "error"])

    fields = [f"`{c.replace('`', '``')}` {kept.schema[c].dataType.simpleString()}" for c in names]
    return kept.select(*(F.col(f"`{c.replace('`', '``')}`") for c in names), vector).mapInArrow(run, ", ".join([*fields, "codes array<int>", "error long"]))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Integer vectors from entry numbers: what the codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(books.shape[0])], 1)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable embeddings. Repeated rows and ids are rows of their own, null ids come last in the order of the first codebook;
    an empty table gives no rows; a component too large for exact 64-bit distances is an error."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    kept, width = vectors(rows)
    books = train(kept, width)
    if books is None:
        none = kept.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = pinned(encode(kept, books), "codes")
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    out = join_by_size(coded, per_label, ["label"], "rows", coded.count())
    hexes = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return out.select("vec_id", F.array_join(hexes, "").alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(r: int) -> str:
    """Assignment to codebook ``r`` and the next codebook. Distances are whole numbers below 2^53, exact as doubles."""
    return f"""
  near{r} AS MATERIALIZED (
    SELECT id, p.part, p.x, arg_min(entry, CAST(p.xx - 2 * list_inner_product(p.x, b.x) + b.xx AS BIGINT) * 256 + entry) AS entry,
      min(CAST(p.xx - 2 * list_inner_product(p.x, b.x) + b.xx AS BIGINT)) AS error
    FROM parts p JOIN book{r} b ON p.part = b.part GROUP BY id, p.part, p.x),
  mean{r} AS (
    SELECT part, entry, pos, CAST(floor(sum(v) / count(*)) AS DOUBLE) AS v
    FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM near{r}) GROUP BY part, entry, pos),
  moved{r} AS (SELECT part, entry, list(v ORDER BY pos) AS x FROM mean{r} GROUP BY part, entry),
  book{r + 1} AS MATERIALIZED (
    SELECT part, entry, x, list_inner_product(x, x) AS xx
    FROM (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN moved{r} m ON m.part = b.part AND m.entry = b.entry))"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  rows_ AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS id, vec_id, label, v FROM kept),
  parts AS MATERIALIZED (
    SELECT id, part, x, list_inner_product(x, x) AS xx
    FROM (SELECT id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM rows_, range(4) t(part))),
  book0 AS MATERIALIZED (SELECT part, id AS entry, x, xx FROM parts WHERE id < 256),
  {','.join(_round_sql(r) for r in range(ROUNDS + 1))},
  coded AS (
    SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY id),
  digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h
    FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM rows_ JOIN coded USING (id), digest
"""
