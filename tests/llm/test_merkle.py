"""Merkle manifest against a recursive tree in Python, on odd and empty tables too."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from murmur.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part string, node string, at long, proof int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((i - run, [x for j, x in enumerate(level[run:run + 3]) if j != i - run]))
        i //= 3
    return out


def by_force(rows):
    """Sorted result rows of the query for tuples (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[1], []).append(r)
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees, places = {}, {}
    for s in order:
        places[s] = sorted(parts[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in places[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for p, s in enumerate(order):
        for i, r in enumerate(places[s]):
            steps = proof(trees[s], i) + proof(top, p)
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4].replace("\n", "") if cut and r[4] is not None else r[4]))
            for at, others in steps:
                node = sha("".join([*others[:at], node, *others[at:]]))
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha("".join(x for _, o in steps for x in o)), node, node == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 3, 4) for r in rows], SCHEMA)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def text(r):
    return r.choice(["", "a\nb", "line\n" * r.randrange(5), "é∑\n", "plain", None])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 1}, {"b": 82, "a": 28, "é": 9, "z": 4, "": 2, None: 81}, {"hot": 260, "c": 244}])
def test_proofs_equal_the_recursive_tree(spark, tmp_path, sizes):
    r = random.Random(4)
    ids = iter(r.sample(range(10**12), 1000))
    rows = [(next(ids), s, r.choice(["en", None]), r.choice([None, 5]), text(r)) for s, n in sizes.items() for _ in range(n)]
    assert run(spark, tmp_path, rows) == by_force(rows)


def test_more_parts_than_a_block_holds(spark, tmp_path):
    rows = [(i, f"s{i % 90}", "en", i, f"t{i}\n") for i in range(200)]
    assert run(spark, tmp_path, rows) == by_force(rows)


def test_null_ids_repeated_rows_and_long_texts(spark, tmp_path):
    rows = [(None, "a", None, None, None)] * 40 + [(7, "a", "en", 3, "x\ny")] * 50 + [(7, "a", "en", 4, "other\n")] * 2
    rows += [(None, None, "en", 1, "n\n"), (9_007_199_254_740_993, "a", "en", 1, "z\n" * 200_000), (9_007_199_254_740_992, "a", "en", 1, "z")]
    assert run(spark, tmp_path, rows) == by_force(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_a_stored_manifest_finds_the_changed_row(spark, tmp_path):
    """Interior levels are not stored, the manifest serves later sessions, and one changed row is found by its proof."""
    docs = spark.createDataFrame([(i, f"s{i % 2}", "en", i, f"text {i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    path = merkle.manifest(docs, path=f"{tmp_path}/m")
    held = spark.read.parquet(f"{path}/parts/level-0").select(F.sum(F.size("kids"))).first()[0]
    above = spark.read.parquet(f"{path}/parts/level-1").select(F.sum(F.size("kids"))).first()[0]
    assert (held, above) == (300, 4)
    stored = merkle.proofs(spark, path)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 123, "altered").otherwise(F.col("text")))
    now = changed.select("doc_id", merkle.leaf_hash([F.col(f) for f in merkle.FIELDS]).alias("now"))
    wrong = stored.join(now, stored["key"] == now["doc_id"]).where(merkle.folded(F.col("now"), F.col("proof")) != F.lit(merkle.root(spark, path)))
    assert [r["doc_id"] for r in wrong.collect()] == [123]
    assert merkle.root(spark, merkle.manifest(docs.where("false"))) is None
