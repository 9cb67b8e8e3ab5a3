"""Secret scans with corpus-wide ownership frequency.

Patterns propose spans in every text. Each candidate's value is hashed, and the hashes are counted over
the whole corpus by distinct repositories and distinct owners: a value that many owners hold
is a copied example; one that stays with few owners looks live.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, table

#: kind, pattern, group that holds the value, least length of that group. The first three are the contract's.
KINDS = (
    ("assign", rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", rb"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is a whole run
    ("provider", rb"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
    ("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = 3
#: Any text with a match of a kind holds one of these: a cheap first look.
_COMPILED = [(k, re.compile(p), g, n) for k, p, g, n in KINDS]


def spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """``(start, kind number, end, value)`` by start, then kind; code points, end exclusive."""
    found = [(m.start(), i, m.end(), m.group(g)) for i, (_, p, g, n) in enumerate(_COMPILED) for m in p.finditer(text) if m.end(g) - m.start(g) >= n]
    if found and not text.isascii():
        points = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
        found = [(int(points[s]), i, int(points[e]), v) for s, i, e, v in found]
    return sorted(found)


def _joined(found) -> str:
    return ",".join(f"{KINDS[i][0]}:{s}:{e}" for s, i, e, _ in found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, candidates`` and, of each
    candidate, ``hash`` (SHA-256 of its value; values are never returned), kind and place."""
    ids, own, rep = (docs.schema[c].dataType.simpleString() for c in (doc_id, owner, repo))

    def find(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for t in b.column(3).to_pylist():
                found = spans(t) if t else []
                base = [x for x in found if x[1] < BASE]
                hashes = [hashlib.sha256(v).hexdigest()[:32] for *_, v in found]
                row = [*(sum(x[1] == k for x in base) for k in range(BASE)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)]
                row.append([{"kind": KINDS[i][0], "start": s, "end": e, "hash": h} for (s, i, e, _), h in zip(found, hashes, strict=True)])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            cand = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, [*kinds, cand], strict=True))],
                names=["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(
        find,
        f"doc_id {ids}, owner {own}, repo {rep}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "candidates array<struct<kind: string, start: long, end: long, hash: string>>",
    )


def ownership(found: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """``hash, n_repos, n_owners, example``: over rows ``hash, owner, repo``. Pairs are made distinct before they are
    counted, so a value that stands in a third of all rows is summed within tasks first. Nulls count as one owner.
    A value is an example if ``example_owners`` owners or ``example_repos`` repositories or more hold it."""
    by_owner = found.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.sum("one").alias("n_owners"))
    by_repo = found.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.sum("one").alias("n_repos"))
    return by_owner.join(by_repo, "hash").withColumn("example", (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos))


def secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", example_owners: int = 3,
    example_repos: int = 100,
) -> DataFrame:
    """One row per document row: the columns of ``scan``, and ``n_live, n_example``: how many of its candidates look
    owner-specific and how many are copies that ``example_owners`` owners or ``example_repos`` repositories or more hold.
    ``candidates`` holds each candidate's ``start, end, kind, n_repos, n_owners, verdict`` (live or example), by start.

    Null texts are empty; null ids, repeated ids and repeated rows keep their rows; null owners are one owner.
    """
    rows = pinned(scan(docs, doc_id, text, repo, owner).withColumn("rid", F.when(F.size("candidates") > 0, F.uuid())), "secrets")
    hits = rows.where("rid IS NOT NULL").select("rid", "owner", "repo", F.explode("candidates").alias("c")).select("rid", "owner", "repo", "c.*")
    verdict = F.when(F.col("example"), "example").otherwise("live").alias("verdict")
    each = F.struct("start", "end", "kind", "n_repos", "n_owners", verdict)
    judged = hits.join(ownership(hits, example_owners, example_repos), "hash").groupBy("rid").agg(
        F.sum((~F.col("example")).cast("long")).alias("n_live"), F.sum(F.col("example").cast("long")).alias("n_example"),
        F.array_sort(F.collect_list(each)).alias("candidates"),
    )
    keep = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    zero, nothing = F.lit(0).cast("long"), F.array().cast(judged.schema["candidates"].dataType)
    without = rows.where("rid IS NULL").select(*keep, zero.alias("n_live"), zero.alias("n_example"), nothing.alias("candidates"))
    return without.unionByName(rows.where("rid IS NOT NULL").drop("candidates").join(judged, "rid").select(*keep, "n_live", "n_example", "candidates"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    fields = ("kind", "start", "end", "n_repos", "n_owners", "verdict")
    joined = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",")
    return out.withColumn("candidates", joined)
