"""Links of a turn join the classes of the turns before; they are not followed again in later turns."""

import random

from pyspark.sql import functions as F

from sparkweave.llm import buckets
from sparkweave.llm import neardup as N
from sparkweave.llm.components import components


def test_each_link_is_followed_once(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=90)
    texts = []
    for i in range(400):
        copy = list(base)
        for _ in range(1 + (i % 3 == 0)):
            copy[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    followed, tables, found = [], buckets.components, []
    monkeypatch.setattr(buckets, "components", lambda links: followed.append(links.count()) or tables(links))
    verified = N.Sets.verified

    def kept(self, pairs, turn):
        out = verified(self, pairs, turn)
        found.append([(r["a"], r["b"]) for r in out.collect()])
        return out

    monkeypatch.setattr(N.Sets, "verified", kept)
    got = N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(map(bool, found)) >= 2, "several turns must find links"
    assert sum(followed) <= sum(map(len, found))
    # The classes are those of all links together.
    links = spark.createDataFrame([p for turn in found for p in turn], "a long, b long")
    whole = components(links)
    assert len({r["label"] for r in got}) == len(texts) - whole.count() + whole.select("label").distinct().count()


def test_merged_equals_components_of_all_links(spark):
    """Classes that meet in a chain, nodes without links before, links inside a class, repeats and both directions."""
    turns = [
        [(5, 6), (6, 7), (10, 11), (20, 21), (30, 31)],
        [(7, 11), (11, 6), (21, 40), (40, 41), (50, 51), (5, 7), (51, 50)],
        [(41, 10), (3, 30), (60, 51), (60, 61)],
        [(31, 30), (5, 10)],
    ]
    labels, links = None, []
    for turn in turns:
        links += turn
        labels = buckets.merged(labels, spark.createDataFrame(turn, "a long, b long"))
        want = components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(labels.collect()) == sorted(want.collect())
        assert labels.count() == labels.select(F.countDistinct("node")).first()[0]
