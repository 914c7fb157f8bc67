"""The near-duplicate stage goes through SimHash fingerprints; what they leave is found by the buckets."""

import random

from sparkweave.llm import buckets
from sparkweave.llm import neardup as N
from sparkweave.llm import simhash


def _copies():
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        copy[rng.randrange(200)] = "other"
        texts += [" ".join(base), " ".join(copy)]
    return texts


def _labels(spark, texts):
    return {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without buckets, most copies are still linked, and nothing else."""
    texts = _copies()
    whole = _labels(spark, texts)
    assert whole == {i: i - i % 2 for i in range(len(texts))}
    members = buckets.members
    monkeypatch.setattr(buckets, "members", lambda nodes, percent: members(nodes, percent).limit(0))
    alone = _labels(spark, texts)
    linked = sum(alone[i] == i - 1 for i in range(1, len(texts), 2))
    assert 30 <= linked <= 40 and all(alone[i] in (i, whole[i]) for i in alone)


def test_equal_fingerprints_make_few_pairs(spark):
    """A group of one fingerprint gives a pair for each further node, not all pairs; nodes without words give none."""
    rows = [(i, 9, 5, i, i << 20, i << 40) for i in range(300)] + [(900, 0, 5, 0, 0, 0), (901, 0, 5, 0, 0, 0)]
    nodes = spark.createDataFrame(rows, "node long, size int, " + ", ".join(f"{f} long" for f in N.FINGERPRINTS))
    pairs = {(r["a"], r["b"]) for r in N.fingerprint_pairs(nodes.select("node", "size", *(nodes["f0"].alias(f) for f in N.FINGERPRINTS))).collect()}
    assert pairs == {(0, i) for i in range(1, 300)}


def test_all_seeds_go_through_one_plan(spark, monkeypatch):
    """Links of all seeds come from one call of the covering tables, and are those of each seed alone."""
    rng = random.Random(7)
    rows = []
    for i in range(0, 120, 2):
        fps = [rng.getrandbits(63) for _ in N.FINGERPRINTS]
        near = [rng.getrandbits(63) for _ in fps]
        near[i // 2 % 4] = fps[i // 2 % 4] ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63)
        rows += [(i, 5, *fps), (i + 1, 5, *near)]
    rows.append((500, 5, rows[0][3], *(rng.getrandbits(63) for _ in range(3))))  # one seed's fingerprint under another seed: no link
    nodes = spark.createDataFrame(rows, "node long, size int, " + ", ".join(f"{f} long" for f in N.FINGERPRINTS))
    calls, links = [], simhash.links_within_two
    monkeypatch.setattr(simhash, "links_within_two", lambda *a: calls.append(1) or links(*a))
    pairs = [(r["a"], r["b"]) for r in N.fingerprint_pairs(nodes).collect()]
    assert sorted(pairs) == [(i, i + 1) for i in range(0, 120, 2)]
    assert len(calls) == 1
