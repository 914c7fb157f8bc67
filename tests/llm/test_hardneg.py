"""Hard negatives against plain loops over all pairs."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from sparkweave.llm import bitsliced
from sparkweave.llm import hardneg as H

LAST = (1 << 63) - 1


def brute(rows, every=5, k=3, positives=5, scale=256):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(scale * Fraction(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, label in good:
        if a % every:
            continue
        near = sorted((-min(max(sum(p * q for p, q in zip(x, y)), -LAST - 1), LAST), i, other == label) for i, y, other in good if i != a)
        for s, p, _ in [n for n in near if n[2]][:positives]:
            window = [n for n in near if not n[2] and 50 * -s <= 100 * -n[0] <= 95 * -s][:k]
            out += [(a, p, r + 1, n[1], -s, -n[0]) for r, n in enumerate(window)]
    return sorted(out)


def found(spark, rows, every=5, **more):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id string, anchor int, __label int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.mined(docs, F.col("id") % every == 0, label, **more).drop("anchor")
    return sorted(tuple(r) for r in got.collect())


def test_against_plain_loops(spark, monkeypatch):
    """Ties, repeated ids, nulls, short vectors, few rows of a label, negative scores; blocks and slots of several tasks."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 40)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 7)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0.2, 0.3) for _ in range(6)], rng.randrange(3)) for i in range(250)]
    rows += [(400 + i, [0.25, 0.5, 0.25], 1) for i in range(12)] + [(450 + i, [0.25, 0.3, 0.25], 2) for i in range(12)]
    rows += [(rows[10][0], rows[20][1], 1), rows[15], (15, [1.0], 1), (500, [-0.5] * 6, 8), (505, [0.0] * 6, 8), (510, [], 9), (515, [3.0], 4)]
    rows += [(600, None, 1), (605, [1.0, None], 1), (610, [float("nan")] * 6, 1), (615, [math.inf], 1), (None, [1.0], 1), (620, [1.0] * 6, None)]
    want = brute(rows)
    assert len(want) > 300
    assert found(spark, rows) == want


def test_large_components(spark, monkeypatch):
    """Beyond doubles, beyond 64 bits, and a very long vector."""
    monkeypatch.setattr(bitsliced, "AREA", 5000)
    rng = random.Random(2)
    rows = [(i, [rng.choice([4e7, 1e6, 1e9, 0.3, 2.0**24]) for _ in range(4)], rng.randrange(2)) for i in range(60)]
    rows += [(100 + i, [rng.uniform(0, 8000) for _ in range(4)], 1) for i in range(20)]
    rows += [(200, [1e300, 1.0], 1), (205, [1.5e300, 2.0], 1), (201, [0.9e300], 2), (210, [rng.gauss(0.3, 1) for _ in range(20_000)], 1), (211, [rng.gauss(0.3, 1) for _ in range(20_000)], 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_no_positives(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1), (1, [0.9], 2)]) == []
