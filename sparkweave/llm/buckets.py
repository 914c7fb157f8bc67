"""Classes of similar sets, found in buckets without writing all pairs of a bucket.

A node is a set of shingles, given by its size and its first shingles under an order that all nodes share. Of two sets with x <= y shingles and a
Jaccard similarity of at least ``percent`` in a hundred, the first shingle that both have is among the first x - ceil(2p/(100+p) x) + 1 of the smaller
one (its index part) and the first y - ceil(p/100 y) + 1 of the larger one. So the nodes that have a shingle in these parts are
a bucket, and pairs of an index part and another part are compared, as far as sizes and places allow the similarity.

Every node has a sketch: how often each of ``BITS`` hash values occurs among its shingles, modulo 2. A shingle that only one of
two sets has changes one bit, so sketches that differ in more bits than similar sets can differ in shingles exclude the pair.

A bucket goes on until nothing in it is open: in each turn some nodes of its index part, the pivots, are compared with all others
of other classes and leave the bucket; it ends with its last index part, or when all its nodes are one class. The first turn has one
pivot for a bucket, which gathers groups of copies; later turns take all of a small bucket, and 16 times as many of a large one
each time, and there sketches exclude pairs inside the join, before anything is written. Classes are connected components of
verified links; a turn's links join the classes of the turns before, so each link is followed in one turn only; no link or class comes to
the driver. Links that are found in another way first close buckets before they are opened.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import dropped, written
from sparkweave.llm.components import components

#: Buckets up to SMALL are compared whole after the first turn; those beyond FEW carry sketches then.
SMALL, FEW = 64, 8
#: Bits of a sketch, held as whole numbers of 64.
BITS = 512
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """For each hash value whether an odd number of shingles has it."""
    odd = np.bincount((shingle_set >> np.uint64(24)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def prefix(percent: int, n: int) -> int:
    """How many first shingles of n another set must share one of."""
    return n + (-percent * n // 100) + 1 if n else 0


def members(nodes: DataFrame, percent: int) -> DataFrame:
    """key, node, size, place, index, from node, size and first: the first shingles that several nodes have, with their places; index: in the index part."""
    rows = nodes.select("node", "size", F.posexplode("first").alias("place", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    part = F.col("size") - F.ceil(2 * percent / (100 + percent) * F.col("size") - 1e-6) + 1
    return rows.join(shared, "key").select("key", "node", "size", "place", (F.col("place") < part).alias("index"))


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets that have nodes of several classes and an index part, with label and the bucket's n."""
    rows = rows.drop("label", "n")
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("index").alias("any"))
    return rows.join(stats.where("low <> high and any").select("key", "n"), "key")


def _with_sketches(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sketches for the members of buckets beyond FEW, null ones for the rest."""
    few = rows.where(F.col("n") <= FEW).select("*", *(F.lit(None).cast("long").alias(s) for s in SKETCH))
    return rows.where(F.col("n") > FEW).join(nodes.select("node", *SKETCH), "node").select(*few.columns).unionByName(few)


def _chosen(rows: DataFrame, turn: int) -> DataFrame:
    """The turn's pivots: all columns but index and n."""
    index = rows.where("index").drop("index")
    names = [c for c in index.columns if c not in ("key", "n")]
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), *names)
    slot = F.pmod(F.xxhash64("node", F.lit("slot")), F.lit(16**turn))
    some = index.where(F.col("n") > SMALL if turn else F.lit(True)).groupBy("key", slot.alias("slot")).agg(F.min(order).alias("p")).select("key", *(f"p.{c}" for c in names))
    return some.unionByName(index.where(F.col("n") <= SMALL).select(*some.columns)) if turn else some


def _possible(percent: int) -> Column:
    """Whether sizes and places leave room for the similarity, if the shingle is the first one that both sets have."""
    small, large = F.least("p.size", "m.size"), F.greatest("p.size", "m.size")
    rest = F.least(F.col("p.size") - F.col("p.place"), F.col("m.size") - F.col("m.place"))
    return (100 * small >= percent * large) & ((100 + percent) * rest >= percent * (small + large))


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sketches do not exclude the similarity; ``a`` and ``b`` begin the names of both sides' columns. Null without sketches."""
    apart = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH), F.lit(0))
    sizes = F.col(a + "size") + F.col(b + "size")
    return apart <= sizes - 2 * F.ceil(percent / (100 + percent) * sizes - 1e-6)


def ends(pairs: DataFrame) -> DataFrame:
    """The different nodes of pairs a, b."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label: the least node of the class; or null) after further links a, b: the same labels as ``components`` gives for all links
    together. Only pairs of classes that the new links join go through its rounds, each once. A written table."""
    if labels is None:
        return components(links)
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias("label_" + x))
    met = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    across = written(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    roots = components(across)
    # A root's node is a class's label or a node that had no links before.
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    out = written(moved.unionByName(roots.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
    dropped(across, roots)
    return out


class _Links:
    """The classes that verified links make. ``nodes``: node, size and SKETCH."""

    def __init__(self, nodes: DataFrame, percent: int, verified) -> None:
        self.nodes, self.percent, self.verified = nodes, percent, verified
        self.labels = self.tried = None
        self.tables: list[DataFrame] = []

    def look(self, pairs: DataFrame, turn: int) -> None:
        """Verifies different pairs a, b that sketches do not exclude and that were not verified before."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        # What sketches exclude is not remembered: they exclude it again.
        side = lambda x: self.nodes.select(F.col("node").alias(x), *(F.col(c).alias(x + c) for c in ("size", *SKETCH)))
        likely = written(pairs.join(side("a"), "a").join(side("b"), "b").where(alike("a", "b", self.percent)).select("a", "b"), "likely")
        self.tables.append(likely)
        if not likely.limit(1).count():
            return
        self.tried = likely if self.tried is None else self.tried.unionByName(likely)
        found = self.verified(likely, turn)
        if found.limit(1).count():
            before, self.labels = self.labels, merged(self.labels, found)
            dropped(*([] if before is None else [before]))
        dropped(found)


def classes(nodes: DataFrame, percent: int, verified, near: DataFrame | None = None) -> DataFrame | None:
    """node, label of the nodes that have links (a written table), or null if there are none.

    ``nodes``: node, size, first (``prefix`` shingles by the common order) and SKETCH. ``verified(pairs, turn)`` returns those of the
    pairs a, b that are similar, as a written table. ``near``: different pairs a, b to look at first; buckets then begin with their classes.
    """
    found = _Links(nodes, percent, verified)
    if near is not None:
        found.look(near, -1)
    rows, turn = written(members(nodes, percent), "members"), 0
    while True:
        now = _open(rows, found.labels)
        now = written(now if turn != 1 else _with_sketches(now, nodes), "members")
        dropped(rows)
        rows = now
        if not rows.limit(1).count():
            break
        pivots = written(_chosen(rows, turn), "pivots")
        meet = (F.col("p.label") != F.col("m.label")) & _possible(percent)
        if turn:
            meet = meet & F.coalesce(alike("p.", "m.", percent), F.lit(True))
        pairs = pivots.alias("p").join(rows.alias("m"), F.expr("p.key = m.key") & meet)
        found.look(pairs.select(F.least("p.node", "m.node").alias("a"), F.greatest("p.node", "m.node").alias("b")).distinct(), turn)
        rest = written(rows.join(pivots.select("key", "node"), ["key", "node"], "left_anti"), "members")
        dropped(rows, pivots)
        rows = rest
        turn += 1
    dropped(rows, *found.tables)
    return found.labels
