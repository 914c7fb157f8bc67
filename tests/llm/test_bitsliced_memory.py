"""Blocks of the index meet groups of queries one pair at a time, and what is shuffled are results."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import bitsliced as B
from test_bitsliced import brute

SMALL_HEAP = """
from pyspark.sql import SparkSession, functions as F
from sparkweave.llm import bitsliced as B

B.BLOCK_QUERIES = 4
spark = (
    SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", FOLDER).getOrCreate()
)
x = "transform(sequence(1, 64), i -> IF(id % 20 > 0 OR i <= 3, CAST(pmod(hash(id, i), 2000) - 1000 AS FLOAT), 0F))"
rows = spark.range(0, 32768, 1, 4).selectExpr("id AS vec_id", x + " AS embedding")
got = B.top_k(rows, F.col("id") % 20 == 0).cache()
assert got.count() == 1639 * 20
query = rows.where("vec_id = 40").first()["embedding"]
score = sum((F.floor(64 * F.col("embedding")[i].cast("double")) * int(64 * q) for i, q in enumerate(query) if q), F.lit(0))
want = rows.where("vec_id <> 40").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20).collect()
assert [(r["vec_id"], r["score"]) for r in got.where("query_id = 40").orderBy("rank").collect()] == [tuple(r) for r in want]
print("whole")
"""


def test_many_groups_in_a_small_heap(tmp_path):
    """Blocks of 2 MB meet hundreds of groups; the rows of one block's pairs together don't fit this heap."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", SMALL_HEAP.replace("FOLDER", repr(str(tmp_path)))], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "whole" in done.stdout, done.stderr[-2000:]


def test_many_blocks_slices_and_groups(spark, monkeypatch):
    """Ties between blocks, parts and slices, repeated ids, wide vectors beside others, whatever is cut where."""
    for name, value in (("BLOCK_ROWS", 16), ("BLOCK_QUERIES", 2), ("GROUP_QUERIES", 5), ("SLICE_BLOCKS", 4), ("PAIRS", 9), ("EXACT_AREA", 30)):
        monkeypatch.setattr(B, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(5)], 1) for i in range(500)]
    rows += [(i, [rng.choice([1e12, -3.0, 0.25]) for _ in range(rng.choice([2, 5, 40]))], 1) for i in range(600, 640)] + rows[40:62]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int").repartition(3)
    found = []
    monkeypatch.setattr(B, "_found", lambda *a, f=B._found: found.append(f(*a)) or found[-1])
    got = B.top_k(docs, F.col("id") % 20 == 0, k=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    asked = sum(r[0] % 20 == 0 for r in rows)
    blocks = found[0].count() / 20 / asked
    assert blocks <= 10  # results of slices; there are 36 blocks at least
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("left_out", [0, 1, 2])
def test_a_block_below_a_known_score(left_out):
    rng = np.random.default_rng(6)
    for n, dims, high in ((1, 3, 5), (64, 8, 64), (1000, 16, 64), (700, 5, 1)):
        ids, values = rng.permutation(n * 3)[:n], rng.integers(-high, high + 1, (n, dims))
        block = B.Block(ids, values.astype(np.int8), left_out)
        for _ in range(5):
            query = rng.integers(-high, high + 1, dims)
            scores = np.sort(values @ query)
            for least in (int(scores[0]) - 1, int(np.median(scores)), int(scores[-1]), int(scores[-1]) + 1):
                got = block.top(query, 20, -1, least)
                want = sorted((-int(v @ query), int(i)) for i, v in zip(ids, values))[:20]
                assert [x for x in zip((-got[1]).tolist(), got[0].tolist()) if -x[0] >= least] == [x for x in want if -x[0] >= least]


def test_whole_numbers_are_as_narrow_as_they_can(spark):
    rows = spark.createDataFrame([(i, [x] * 3) for i, x in enumerate([1.0, 100.0, 1e5, 1e15])], "id long, x array<double>")
    for top, width in ((1, 1), (2, 2), (3, 4)):
        row = B._packed(rows.where(F.col("id") < top), 1, 100, 1000, 64).first().asDict()
        assert len(row["v"]) == top * 3 * width
        assert B._matrix(row)[1].tolist() == [[64 * int(x)] * 3 for x in (1, 100, 1e5)[:top]]
