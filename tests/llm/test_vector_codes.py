"""Vector codes against plain whole-number k-means in Python, on odd and empty tables too."""

import hashlib
import math
import random

import numpy as np
import pytest

from murmur.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, codes int, error string, n long"


def by_force(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    long = -(-max(1, max(len(v) for *_, v in kept)) // parts)
    kept = [(i, lab, v + [0] * (long * parts - len(v))) for i, lab, v in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[tuple(r[2][p * long:(p + 1) * long]) for r in start] for p in range(parts)]

    def assign():
        out = []
        for *_, v in kept:
            row = []
            for p in range(parts):
                x = v[p * long:(p + 1) * long]
                row.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            held = {}
            for (*_, v), row in zip(kept, got):
                held.setdefault(row[p][1], []).append(v[p * long:(p + 1) * long])
            for j, xs in held.items():
                books[p][j] = tuple(sum(c) // len(xs) for c in zip(*xs))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    got = assign()
    errors = [sum(d for d, _ in row) for row in got]
    per = {}
    for (_, lab, _), e in zip(kept, errors):
        per[lab] = per.get(lab, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in row), e, per[lab], digest) for (i, lab, _), row, e in zip(kept, got, errors)), key=repr)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    got = vc.op13_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vector(r, n, spread=1.0):
    return [r.uniform(-spread, spread) for _ in range(n)]


@pytest.mark.parametrize("n,length,spread", [(300, 12, 1.0), (290, 8, 0.004), (40, 20, 9.0), (1, 4, 1.0), (3, 2, 1.0)])
def test_codes_equal_plain_k_means(spark, tmp_path, n, length, spread):
    r = random.Random(n)
    rows = [(i * 7 % n, vector(r, length, spread), r.choice([1, 2, None])) for i in range(n)]
    assert run(spark, tmp_path, rows) == by_force(rows)


def test_odd_rows(spark, tmp_path):
    r = random.Random(1)
    same = vector(r, 8)
    rows = [(5, same, 1)] * 130 + [(None, vector(r, 8), None) for _ in range(70)] + [(i, vector(r, 8), 1) for i in range(70)]
    rows += [(5, vector(r, 8), 2), (1, None, 1), (2, [0.0, None, 1.0, 2.0], 1), (3, [float("nan")] * 8, 1), (4, [1.0, float("-inf")], None)]
    rows += [(6, [], 1), (7, [0.5], 3), (8, [-0.00001] * 8, 3), (9, vector(r, 5), None)]
    got = run(spark, tmp_path, rows)
    assert got == by_force(rows) and len(got) == len(rows) - 4


def test_tables_without_a_usable_vector(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(1, None, 1), (2, [None, 1.0], None)]) == []
    assert run(spark, tmp_path, [(1, [], 1)]) == by_force([(1, [], 1)])


def test_a_component_beyond_exact_distances_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="beyond exact"):
        run(spark, tmp_path, [(1, [1e9] * 64, 1)])


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 16, 33])
def test_early_elimination_finds_the_lowest_of_the_nearest(length):
    r = np.random.default_rng(length)
    for spread in (2, 5, 2000):
        x, book = r.integers(-spread, spread + 1, (400, length)), r.integers(-spread, spread + 1, (50, length))
        book[30:] = book[:20]  # equal entries
        code, scaled = vc.nearest(vc.walsh(x), vc.walsh(book))
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (scaled == full.min(1) * vc.walsh(x).shape[1]).all()


def test_the_transform_is_in_sequency_order():
    rows = vc.walsh(np.eye(16, dtype=np.int64)).T  # one row a coefficient
    assert [int((np.diff(row) != 0).sum()) for row in rows] == list(range(16))
    assert (rows @ rows.T == 16 * np.eye(16)).all()


def test_decoding_gives_the_entries_back(spark):
    r = random.Random(8)
    rows = spark.createDataFrame([(i, vector(r, 8), 0) for i in range(60)], "vec_id long, embedding array<float>, label int")
    kept, width = vc.vectors(rows)
    books = vc.train(kept, width)
    got = vc.encode(kept, books).join(kept.withColumnRenamed("embedding", "v"), "vec_id").collect()
    back = vc.decode(np.array([x["codes"] for x in got]), books)
    assert [x["error"] for x in got] == ((back - np.array([x["v"] for x in got])) ** 2).sum(1).tolist()
