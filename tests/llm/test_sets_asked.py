"""Whole sets move once: a later turn takes only those that its pairs ask for."""

from sparkweave.llm import jaccard as J
from sparkweave.llm import neardup as N
from sparkweave.llm.common import written


def test_later_turns_take_the_sets_of_their_pairs(spark, monkeypatch):
    texts = [f"a{i} b c d e f g h i j k" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    owners = spark.createDataFrame([(i, i, *N._identity(N._words(t))) for i, t in enumerate(texts)], "node long, doc_id long, t0 long, t1 long")
    seen, similar = [], N.similar
    monkeypatch.setattr(N, "similar", lambda pairs, sets, percent: seen.append(sorted(r["node"] for r in sets.collect())) or similar(pairs, sets, percent))
    sets = N.Sets(docs, owners, 50, False)
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert sets.verified(pairs([(i, i + 1) for i in range(0, 12, 2)]), 0).count() == 6
    assert [tuple(r) for r in sets.verified(pairs([(1, 4)]), 1).collect()] == [(1, 4)]
    assert seen == [list(range(12)), [1, 4]]


def test_orders_are_read_for_the_nodes_of_pairs(spark, monkeypatch):
    nodes = written(spark.createDataFrame([(i, [1, 2], [3, i]) for i in range(9)], "node long, order0 array<int>, order1 array<int>"), "nodes")
    pairs = spark.createDataFrame([(1, 2), (3, 8)], "a long, b long")
    out = J.under_all_orders(pairs, nodes)
    assert sorted(map(tuple, out.collect())) == [(1, 2), (3, 8)] and out._written_path
