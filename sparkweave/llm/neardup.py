"""Near-duplicate documents: SimHash by covering hashing, verified by Jaccard similarity; a prefix filter for what fingerprints leave.

Texts are compared by their lower-case (A-Z) words. Equal word sequences are one text. Two texts are linked if the sets of their
five-word shingles have a Jaccard similarity of at least 0.8. All links count: the classes are those of brute force, but for
collisions of 64-bit hashes.

Every text has ``FINGERPRINTS``, the bitwise majorities of the hashes of its different words under as many seeds: a few other words move few
bits, so most near copies are within 2 bits in one of them. ``simhash.links_within_two`` finds these by its covering tables; the pairs are verified, and their
classes are what the second step begins with.

Fingerprints alone would miss links, so the rest is found exactly. The shingles of each text are put into one order for all texts, rare ones first; how
rare is read from counts under ``COUNTERS`` hash values, and any order would give the same classes. ``buckets`` finds the pairs of different classes
that share one of their first shingles, excludes pairs by their sketches, and turns verified links into classes. Only texts of pairs that remain are
read again, for their whole sets; no shingle comes to the driver, only the counts.

Cases: null, empty and blank texts are one text without words; texts of fewer than five words are one shingle; rows with
one doc_id and different texts are documents of their own, equal ones are copies; of rows with the least doc_id of a class one stays; a
null doc_id is a document of its own that is never dropped; an empty table gives no rows; other columns stay as they are; texts are read whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkweave.llm import buckets, simhash
from sparkweave.llm.buckets import SKETCH, prefix, sketch
from sparkweave.llm.common import dropped, free_names, in_arrow, written

WIDTH, PERCENT = 5, 80
#: Columns of fingerprints, and the odd factors that make one seed's hashes of another's.
FINGERPRINTS = [f"f{i}" for i in range(4)]
_SEEDS = np.array([xxhash.xxh64_intdigest(b"fingerprint", i) | 1 for i in range(len(FINGERPRINTS))], np.uint64)
#: Hash values under which shingles are counted.
COUNTERS = 1 << 18
#: Hash values of a bitmap of wanted ids.
SLOTS = 1 << 23
#: Odd factors of the places in a shingle.
_FACTORS = np.array([xxhash.xxh64_intdigest(b"place", i) | 1 for i in range(WIDTH)], np.uint64)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out += hashes[i : i + n] * _FACTORS[i]
    return np.unique(out ^ (out >> np.uint64(29)))


def fingerprints(words: list[bytes]) -> list[int]:
    """A SimHash fingerprint of the different words for each seed."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in set(words)], np.uint64)
    out = []
    for seed in _SEEDS:
        ones = np.zeros(64, np.int64)
        for low in range(0, len(hashes), simhash.BLOCK):
            mixed = hashes[low : low + simhash.BLOCK] * seed
            mixed = (mixed ^ (mixed >> np.uint64(32))) * seed
            ones += simhash.bit_counts(mixed ^ (mixed >> np.uint64(29)))
        out.append(simhash.majority(ones, len(hashes)))
    return out


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes with words whose fingerprints are within 2 bits under some seed. Of equal fingerprints the least node stands for all: the others meet
    it, and it meets those that links lead to, so pairs grow with the nodes and not with their squares. All seeds go through one plan; a plan for each
    would compile and hold its steps as often as there are seeds."""
    fps = nodes.where("size > 0").select("node", F.posexplode(F.array(*FINGERPRINTS)).alias("seed", "fp"))
    heads = written(fps.groupBy("seed", "fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    links = written(simhash.links_within_two(heads.select("seed", "fp"), "seed"), "links")
    head = lambda x: heads.select("seed", F.col("fp").alias(x), F.col("head").alias("head_" + x))
    equal = fps.join(heads.where("n > 1"), ["seed", "fp"]).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    across = links.join(head("a"), ["seed", "a"]).join(head("b"), ["seed", "b"])
    out = written(equal.unionByName(across.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))).distinct(), "near")
    dropped(heads, links)
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _identity(words: list[bytes]) -> tuple[int, int]:
    t = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(t[:8], "little", signed=True), int.from_bytes(t[8:], "little", signed=True)


def shingle_counts(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many texts have a shingle of each hash value."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount((shingles(_words(text), width) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) if text else 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["h", "n"])

    found = docs.select("text").transform(in_arrow, run, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("h").to_numpy()] = found.column("n").to_numpy()
    return out


def rare_first(shingle_set: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return shingle_set[np.lexsort((shingle_set, counts[(shingle_set % np.uint64(COUNTERS)).astype(np.int64)]))]


def _texts(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, t0, t1 (a 128-bit hash of the word sequence), size (distinct shingles), the first shingles, the fingerprints and the sketch for every row."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))

    def run(batches):
        order = counts.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            bits = []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                s = shingles(words)
                first = rare_first(s, order)[: prefix(percent, len(s))]
                for column, value in zip(out, (*_identity(words), len(s), first.view(np.int64))):
                    column.append(value)
                bits.append([*fingerprints(words), *sketch(s)])
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            names = [*FINGERPRINTS, *SKETCH]
            numbers = np.array(bits, np.int64).reshape(-1, len(names)).T
            columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types)), *(pa.array(np.ascontiguousarray(b)) for b in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t0", "t1", "size", "first", *names])

    return docs.transform(in_arrow, run, "doc_id long, t0 long, t1 long, size int, first array<long>, " + ", ".join(f"{b} long" for b in (*FINGERPRINTS, *SKETCH)))


def _slots(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def shingle_sets(docs: DataFrame, need: DataFrame, identity=_identity, width: int = WIDTH) -> DataFrame:
    """node, shingles of the documents that ``need`` (node, doc_id, t0, t1) lists. ``docs``: doc_id, text.

    Texts stay where they are: a bitmap of SLOTS hash values of the wanted ids, whatever their number, goes to the tasks, which make the sets of
    the rows that it lets through; sets and list are joined then.
    """
    slot = _slots(F.col("doc_id"))
    bits = need.select(slot.alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS // 64, np.int64)
    bitmap[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap.astype("<i8").view(np.uint8))

    def run(batches):
        let_through = np.unpackbits(wanted.value, bitorder="little").astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(let_through[batch.column("slot").to_numpy(zero_copy_only=False)]))
            out: list[list] = [[], [], []]
            for text in batch.column("text"):
                words = _words(text.as_py())
                for column, value in zip(out, (*identity(words), shingles(words, width).view(np.int64))):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "t0", "t1", "shingles"])

    found = docs.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).transform(in_arrow, run, "doc_id long, t0 long, t1 long, shingles array<long>")
    return found.join(need, ["doc_id", "t0", "t1"]).select("node", "shingles")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least ``percent`` in a hundred."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where((F.size("sa") > 0) & (100 * both >= percent * (F.size("sa") + F.size("sb") - both))).select("a", "b")


class Sets:
    """Verifies pairs by their whole sets, which are read once for each node. ``docs``: doc_id, text; ``owners``: node, doc_id, t0, t1, one document for each node."""

    def __init__(self, docs: DataFrame, owners: DataFrame, percent: int, repeats: bool, identity=_identity, width: int = WIDTH) -> None:
        self.docs, self.owners, self.percent, self.repeats, self.identity, self.width = docs, owners, percent, repeats, identity, width
        self.tables: list[DataFrame] = []

    def verified(self, pairs: DataFrame, turn: int) -> DataFrame:
        asked = written(buckets.ends(pairs), "asked")
        need = asked
        for known in self.tables:
            need = need.join(known.select("node"), "node", "left_anti")
        need = written(need.join(self.owners.select("node", "doc_id", "t0", "t1"), "node"), "need")
        more = shingle_sets(self.docs, need, self.identity, self.width)
        self.tables.append(written(more.dropDuplicates(["node"]) if self.repeats else more, "shingles"))
        dropped(need)
        # Of the sets of earlier turns only those that are asked for move.
        sets = reduce(DataFrame.unionByName, self.tables).join(asked, "node", "left_semi")
        out = written(similar(pairs, sets, self.percent), "similar")
        dropped(asked)
        return out

    def drop(self) -> None:
        dropped(*self.tables)


def identified(docs: DataFrame, t0: str, t1: str) -> DataFrame:
    """``docs`` with a 128-bit hash of the words of the column text in the new columns t0 and t1."""
    names = docs.columns
    (whole,) = free_names(names, "__text")

    def run(batches):
        for batch in batches:
            found = [_identity(_words(text)) for text in batch.column(whole).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=[*names, t0, t1])

    schema = StructType([*docs.schema.fields, StructField(t0, LongType()), StructField(t1, LongType())])
    return docs.withColumn(whole, F.col("text").cast("string")).transform(in_arrow, run, schema)


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, t0, t1, label (a number for the class) and class_id, its least doc_id, for every different text (t0, t1) of a doc_id that is not null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    every = written(_texts(docs, percent), "texts")
    # One number for each different text, and one document that has it.
    equal = every.groupBy("t0", "t1").agg(F.min("doc_id").alias("doc_id"))
    equal = written(equal.withColumn("node", F.monotonically_increasing_id()), "equal")
    texts = every.join(equal, ["doc_id", "t0", "t1"])
    repeats = every.count() > every.select("doc_id").distinct().count()
    if repeats:
        texts = texts.dropDuplicates(["node"])
    texts = written(texts.drop("doc_id", "t0", "t1"), "nodes")
    ids = written(every.select("doc_id", "t0", "t1"), "ids")
    dropped(every)
    sets = Sets(docs, equal, percent, repeats)
    near = fingerprint_pairs(texts)
    labels = buckets.classes(texts, percent, sets.verified, near)
    dropped(near)
    sets.drop()
    dropped(texts)
    links = equal.select("node", F.col("node").alias("label")).limit(0) if labels is None else labels
    labelled = equal.join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = labelled.join(roots, "label").select("t0", "t1", "label", "class_id")
    out = written(ids.distinct().join(named, ["t0", "t1"]).select("doc_id", "t0", "t1", "label", "class_id"), "classes")
    dropped(equal, ids, *([] if labels is None else [labels]))
    return out


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the rows of ``docs`` one for each class, one with its least doc_id, and all rows without a doc_id."""
    found = classes(docs, percent)
    gone, kept, t0, t1 = free_names(docs.columns, "__gone", "__kept", "__t0", "__t1")
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        least = found.where("class_id = doc_id").groupBy("label", "class_id").agg(F.min(F.struct("t0", "t1")).alias("t"))
        least = written(least.select(F.col("class_id").alias(kept), F.col("t.t0").alias(t0), F.col("t.t1").alias(t1)), "kept")
        one = identified(docs, t0, t1).withColumn(kept, F.col("doc_id").cast("long")).join(least, [kept, t0, t1]).dropDuplicates([kept, t0, t1])
        return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
    others = found.where("class_id <> doc_id").select(F.col("doc_id").alias(gone))
    return docs.join(others, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
