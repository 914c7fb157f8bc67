"""Similarity join on word n-grams by multiple global orders.

A document's set are its distinct three-word shingles (A-Z lower-cased); with fewer words, the whole sequence. Two documents link if
their sets have a Jaccard similarity of at least 0.9. In any order of all shingles, two such sets share one of their first shingles
(``buckets.prefix``), so a pair is a candidate only if it does so under each of several orders: rare shingles first, and ``ORDERS`` orders by
different hashes. Pairs come from the buckets of the first order; those whose first shingles have nothing in common under one of the others,
or whose sketches differ too much, go; what is left is verified by the whole sets. Documents with equal sets are one node, so copies are never
paired. Components of verified links are found in rounds, without bringing links to the driver.

Cases: null, empty and blank texts have no shingles and no links, and are their own component; rows are documents of their own, also with one
doc_id; a row without an id links like others, but a component's id is null only where all its ids are; repeated rows come back as often as
they occur; an empty table gives no rows; other columns are ignored; texts are read whole. Results are those of brute force, but for collisions of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import buckets
from sparkweave.llm.buckets import SKETCH, prefix, sketch
from sparkweave.llm.common import dropped, in_arrow, table, written
from sparkweave.llm.neardup import Sets, _words, rare_first, shingle_counts, shingles

WIDTH, PERCENT = 3, 90
#: Orders beside that by rarity: odd factors whose products with a shingle's hash are sorted.
ORDERS = tuple(xxhash.xxh64_intdigest(b"order", i) | 1 for i in range(2))
ORDERED = [f"order{i}" for i in range(len(ORDERS))]


def set_identity(shingle_set: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set as two numbers."""
    t = xxhash.xxh3_128_digest(shingle_set.tobytes())
    return int.from_bytes(t[:8], "little", signed=True), int.from_bytes(t[8:], "little", signed=True)


def _identity(words: list[bytes]) -> tuple[int, int]:
    return set_identity(shingles(words, WIDTH))


def by_order(shingle_set: np.ndarray, factor: int) -> np.ndarray:
    """The set in the order of a hash."""
    return shingle_set[np.argsort(shingle_set * np.uint64(factor), kind="stable")]


def _short(shingle_set: np.ndarray) -> np.ndarray:
    """32 bits of each shingle: enough for a filter, in half the room. Equal shingles stay equal."""
    return shingle_set.astype(np.uint32).view(np.int32)


def sets_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, t0, t1 (the set's identity), size, first (by rarity), ORDERED (the first shingles under each further order) and the sketch for every row."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, WIDTH))

    def run(batches):
        order = counts.value
        for batch in batches:
            out: list[list] = [[] for _ in range(4 + len(ORDERS))]
            sketches = []
            for text in batch.column("text").to_pylist():
                s = shingles(_words(text), WIDTH)
                n = prefix(percent, len(s))
                firsts = [rare_first(s, order)[:n].view(np.int64), *(_short(by_order(s, f)[:n]) for f in ORDERS)]
                for column, value in zip(out, (*set_identity(s), len(s), *firsts)):
                    column.append(value)
                sketches.append(sketch(s))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * len(ORDERS))
            bits = np.array(sketches, np.int64).reshape(-1, len(SKETCH)).T
            columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types)), *(pa.array(np.ascontiguousarray(b)) for b in bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t0", "t1", "size", "first", *ORDERED, *SKETCH])

    lists = "".join(f", {c} array<int>" for c in ORDERED)
    return docs.transform(in_arrow, run, f"doc_id long, t0 long, t1 long, size long, first array<long>{lists}, " + ", ".join(f"{b} long" for b in SKETCH))


def under_all_orders(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that share a first shingle under each of the further orders. Of ``nodes`` only those of the pairs move."""
    asked = written(buckets.ends(pairs), "asked")
    mine = nodes.join(asked, "node", "left_semi")
    side = lambda x: mine.select(F.col("node").alias(x), *(F.col(c).alias(x + c) for c in ORDERED))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    for c in ORDERED:
        both = both.where(F.arrays_overlap("a" + c, "b" + c))
    out = written(both.select("a", "b"), "candidates")
    dropped(asked)
    return out


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(sets_of(docs, percent), "sets")
    rows = written(every.select("doc_id", "t0", "t1", "size"), "rows")
    # One number for each different set, and one row that has it; of equal rows any will do.
    one = rows.where("size > 0").groupBy("t0", "t1").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("key"), F.min("doc_id").alias("least"))
    one = written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # What a node has depends on its set alone, so the row of any document will do; it moves once.
    nodes = every.where("size > 0").dropDuplicates(["t0", "t1"]).join(one.select("t0", "t1", "node"), ["t0", "t1"])
    nodes = written(nodes.select("node", "size", "first", *ORDERED, *SKETCH), "nodes")
    dropped(every)
    repeats = rows.count() > rows.select("doc_id").distinct().count()
    sets = Sets(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))), one.withColumnRenamed("key", "doc_id"), percent, repeats, _identity, WIDTH)

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        candidates = under_all_orders(pairs, nodes)
        out = sets.verified(candidates, turn)
        dropped(candidates)
        return out

    labels = buckets.classes(nodes, percent, verified)
    sets.drop()
    dropped(nodes)
    links = one.select("node", F.col("node").alias("label")).limit(0) if labels is None else labels
    labelled = one.join(links, "node", "left").select("t0", "t1", "least", F.coalesce("label", "node").alias("label"))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = written(labelled.join(roots, "label").select("t0", "t1", "component_id"), "components")
    linked = rows.where("size > 0").join(ids, ["t0", "t1"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
