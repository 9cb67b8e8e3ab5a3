"""Sharding by extendible hashing.

The directory is indexed by the first bits of a 60-bit hash of the document id. A bucket of depth d
holds the documents that share d bits; only a bucket whose bytes exceed the limit is split on
another bit, until each fits. The sums of all prefixes come from one histogram of cells, a few bits
deeper than evenly filled buckets would need; the cells that are still too full there (few) go
through another round with eight more bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, table

BITS = 60


def _hash(doc_id: str):
    """The first 60 bits of the id's MD5 (null ids: those of the empty text)."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(h, depth):
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """``cell, depth, prefix, bytes, docs``: for each cell the shallowest bucket that fits the limit or has one hash
    only; ``depth`` is null where even the cell is too full. The sums of prefixes fall with depth, so the
    shallowest that fits is what splitting bit by bit arrives at."""
    at = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d")).withColumn(
        "p", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("d"))
    )
    sums = at.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = sums.where((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "p", "b", "n")
    best = at.select("cell", "d", "p").join(fits, ["d", "p"], "left").groupBy("cell").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("d", "p", "b", "n"))).alias("x"))
    return best.select("cell", F.col("x.d").alias("depth"), F.col("x.p").alias("prefix"), F.col("x.b").alias("bytes"), F.col("x.n").alias("docs"))


def directory(rows: DataFrame, limit: int, spare_bits: int = 3) -> list[tuple[int, DataFrame]]:
    """``[(bits, cells)]``: the rounds of the directory over rows ``h, b`` (hash and bytes), each a table of ``_leaves``.

    A row's bucket is that of its cell in the first round whose cell has one. The number of cells is
    about 2^spare_bits a shard; only sums and counts come to the driver.
    """
    total = rows.agg(F.sum("b")).first()[0] or 0
    bits = min(BITS, max(0, (-(-total // limit)).bit_length()) + spare_bits)
    rounds, left = [], rows
    while True:
        cells = left.groupBy(_prefix(F.col("h"), F.lit(bits)).alias("cell")).agg(
            F.sum("b").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        found = pinned(_leaves(cells, bits, limit), "directory")
        rounds.append((bits, found))
        full = found.where("depth IS NULL").select(F.col("cell").alias("_c"))
        if bits == BITS or full.isEmpty():
            return rounds
        left = left.join(full, _prefix(F.col("h"), F.lit(bits)) == F.col("_c"), "left_semi")
        bits = min(BITS, bits + 8)


def shards(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard_id, shard_depth, shard_bytes, shard_docs, n_bytes`` (columns of these names are replaced).

    ``shard_id`` is the bucket's bits as text (``*`` for the whole at depth 0). A document's size is
    its UTF-8 bytes, 0 for null. Documents with equal ids share all bits: where such a bucket alone is
    over the limit, its rows are laid one after another into parts, ``bits/part``, each within the
    limit unless one document exceeds it. An empty table gives no rows.
    """
    own = docs.drop("shard_id", "shard_depth", "shard_bytes", "shard_docs", "n_bytes")
    own = own.withColumn("_h", _hash(doc_id)).withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    rounds = directory(pinned(own.select(F.col("_h").alias("h"), F.col("n_bytes").alias("b")), "sizes"), limit)
    bucket = F.lit(None)
    for i, (bits, found) in enumerate(rounds):
        leaf = found.where("depth IS NOT NULL").select(F.col("cell").alias(f"_c{i}"), F.struct("depth", "prefix", "bytes", "docs").alias(f"_x{i}"))
        own = own.join(leaf, _prefix(F.col("_h"), F.lit(bits)) == F.col(f"_c{i}"), "left").drop(f"_c{i}")
        bucket = F.coalesce(bucket, F.col(f"_x{i}")) if i else F.col("_x0")
    own = own.withColumn("_x", bucket).drop(*(f"_x{i}" for i in range(len(rounds))))
    bits = F.when(F.col("_x.depth") == 0, "*").otherwise(F.lpad(F.bin("_x.prefix"), F.col("_x.depth"), F.lit("0")))
    own = own.select(
        *(c for c in own.columns if c not in ("_x", "n_bytes")), "n_bytes", bits.alias("shard_id"), F.col("_x.depth").cast("int").alias("shard_depth"),
        F.col("_x.bytes").alias("shard_bytes"), F.col("_x.docs").alias("shard_docs"),
    )
    fit = own.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    over = own.where((F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1))
    return fit.unionByName(_parts(over, limit, text)).drop("_h")


def _parts(over: DataFrame, limit: int, text: str) -> DataFrame:
    """Rows of equal id that exceed the limit together: sorted by content, each closes its part when full."""
    names = over.columns
    kind = over.sparkSession.createDataFrame([], over.schema).schema

    def lay(batches):
        import pyarrow as pa

        now, part, size = None, 0, 0
        for b in batches:
            ids, n = b.column(names.index("shard_id")).to_pylist(), b.column(names.index("n_bytes")).to_pylist()
            out = []
            for i, x in zip(ids, n, strict=True):
                if i != now:
                    now, part, size = i, 0, 0
                elif size + x > limit:
                    part, size = part + 1, 0
                size += x
                out.append(f"{i}/{part}")
            cols = [pa.array(out) if c == "shard_id" else b.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    laid = over.repartition("shard_id").sortWithinPartitions("shard_id", F.xxhash64(text)).mapInArrow(lay, kind)
    sums = laid.groupBy("shard_id").agg(F.sum("n_bytes").alias("_b"), F.count("*").alias("_n"))
    return laid.join(sums, "shard_id").withColumn("shard_bytes", F.col("_b")).withColumn("shard_docs", F.col("_n")).select(*names)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each shard's rows meet in one task first, so it is one file."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


#: Bytes of text in a shard of the registered query and the pipeline.
LIMIT = 1 << 20


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards(docs, LIMIT).select("doc_id", "n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_docs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, each with its shard."""
    return shards(docs, LIMIT)


ORACLE = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT h FROM documents),
s AS (SELECT k, h >> (60 - k) p, sum(n_bytes)::BIGINT b, count(*) n, min(h) lo, max(h) hi FROM d, range(0, 61) r(k) GROUP BY ALL),
x AS (SELECT d.doc_id, d.n_bytes, min_by((k, p, b, n), k) v
      FROM d, s WHERE d.h >> (60 - k) = p AND (b <= {LIMIT} OR lo = hi) GROUP BY d.doc_id, d.n_bytes)
SELECT doc_id, n_bytes, CASE WHEN v[1] = 0 THEN '*' ELSE lpad(bin(v[2]), v[1]::INT, '0') END shard_id,
       v[1]::INT shard_depth, v[3] shard_bytes, v[4] shard_docs FROM x
"""
