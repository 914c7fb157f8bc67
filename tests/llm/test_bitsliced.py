import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sparkweave.llm import bitsliced as B


def test_block_against_sorting():
    rng = np.random.default_rng(1)
    for n, dims, high in ((1, 3, 5), (63, 8, 2), (64, 8, 64), (1000, 16, 64), (700, 5, 1)):
        ids = rng.permutation(n * 3)[:n]
        values = rng.integers(-high, high + 1, (n, dims))
        for left_out in (0, 1, 2):
            block = B.Block(ids, values, left_out)
            for _ in range(5):
                query, own = rng.integers(-high, high + 1, dims), int(rng.choice(ids))
                got = block.top(query, 20, own)
                want = sorted(((-int(v @ query), int(i)) for i, v in zip(ids, values) if i != own))[:20]
                assert list(zip((-got[1]).tolist(), got[0].tolist())) == want
    assert B.Block(np.array([4, 2]), np.zeros((2, 0), np.int64)).top(np.zeros(0, np.int64), 5, 2)[0].tolist() == [4]


def brute(rows, k=20):
    """(query_id, rank, vec_id, score), once for each copy of a row."""
    last = (1 << 63) - 1
    good = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        scores = [(-min(max(sum(a * b for a, b in zip(x, v)), -last - 1), last), i) for j, x in good if j == q for i, v in good if i != q]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(want)


def test_query_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], 1) for i in range(150)]
    rows += [(200, None, 1), (220, [1.0, None], 1), (240, [float("nan")] * 6, 1), (260, [math.inf] * 6, 1), (None, [1.0], 1), (280, [], 1), (300, [0.5], 1)]
    rows += [(i, [0.25] * 6, 2) for i in range(400, 440)] + [(40, rows[40][1], 3), (41, rows[41][1], 3), (42, [9.0] * 7, 3), (60, [5.0, -5.0], 3)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int").repartition(3)
    assert sorted(tuple(r) for r in B.top_k(docs, F.col("id") % 20 == 0, k=20).collect()) == brute(rows)


def test_large_components_and_a_very_long_vector(spark):
    """Components of any finite size, beside others, and scores beyond 64 bits."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)], 1) for i in range(60)]
    rows += [(i, [rng.choice([4e7, -4e7, 1e9, 0.3, 2.0**24]) for _ in range(4)], 1) for i in range(60, 90)]
    rows += [(100, [1e300, 1.0], 1), (101, [-1.7e308, 2.0], 1), (102, [1e15, -1e15, 1e15], 1), (120, [5e-324] * 4, 1), (140, [rng.gauss(0, 1) for _ in range(50_000)], 1), (141, [1e9] * 3000, 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int").repartition(3)
    assert sorted(tuple(r) for r in B.top_k(docs, F.col("id") % 20 == 0, k=20).collect()) == brute(rows)


def test_few_components_at_once(spark, monkeypatch):
    """Blocks that are cut by size give the same results."""
    monkeypatch.setattr(B, "AREA", 40)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.5) for _ in range(rng.choice([0, 3, 8, 50]))], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    assert sorted(tuple(r) for r in B.top_k(docs, F.col("id") % 20 == 0, k=20).collect()) == brute(rows)


def test_empty_table(spark):
    assert B.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0
