"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority of the hashes of a document's word shingles. For a radius r the
covering family has 2**(r+1) - 1 bit masks: position i gets a nonzero vector m(i) of r+1 bits, and mask v keeps the
positions where m(i) and v have an odd number of common bits. Any r differing positions leave a v that is
orthogonal to all their vectors, so two fingerprints within the radius agree on at least one mask. Inside the
buckets that two or more fingerprints share, links are found exactly: fingerprints within radius 2 that agree
on a mask have a common word one flip away from each. At most 65 fingerprints are within one flip of
a word, so no group of that step grows with the data, however many copies a bucket holds.

Cases: null, empty and blank texts have fingerprint zero, which links like any other; texts shorter than the shingle
are one shingle; repeated rows come back as often as they occur; a null ``doc_id`` never becomes a component's id
unless all ids of the component are null; an empty table gives no rows; other columns are ignored; long texts are
read whole, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import in_arrow, table, unsigned_hex, written
from sparkweave.llm.components import components

#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, count: int) -> int:
    """The signed 64-bit number of the bits that more than half of ``count`` hashes have."""
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[: count - 1] + 1).tolist()]
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for low in range(0, count, BLOCK):
        ones += bit_counts(np.array([digest(joined[a:b], seed) for a, b in zip(begins[low : low + BLOCK], ends[low : low + BLOCK])], dtype="<u8"))
    return majority(ones, count)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp for every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), width, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2**(radius+1) - 1 masks as signed 64-bit numbers; positions are dealt evenly over the nonzero vectors."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def in_tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    """The columns, mask and key for every table."""
    return fps.select("*", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def shared_buckets(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose bucket holds more than one fingerprint. Counts are summed before the shuffle, so large buckets are no hot keys."""
    bucket = [*by, "mask", "key"]
    full = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*bucket)
    return rows.join(full, bucket)


def _flips(fp: Column, mask: Column) -> Column:
    """The word itself and all words that differ in one position outside the mask."""
    ones = F.array(F.lit(0).cast("long"), *(F.lit(b if b < 1 << 63 else b - (1 << 64)).cast("long") for b in (1 << i for i in range(64))))
    return F.transform(F.filter(ones, lambda b: b.bitwiseAND(mask) == 0), lambda b: fp.bitwiseXOR(b))


def links_within_two(fps: DataFrame, *by: str) -> DataFrame:
    """Links a, b between distinct fingerprints that join all pairs within 2 bits (as stars: a is the least of a word's neighbours).

    ``by``: columns beside fp; fingerprints that differ in them are kinds of their own, which all go through one plan.
    """
    rows = shared_buckets(in_tables(fps, covering_masks(2)), *by)
    near = rows.select(*by, "fp", F.explode(_flips(F.col("fp"), F.col("mask"))).alias("word")).distinct()
    stars = near.groupBy(*by, "word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return stars.select(*by, F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id that links of at most 2 differing bits reach."""
    marked = written(fingerprints(docs, width, seed), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links_within_two(distinct.select("fp")))
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labelled.join(roots, "label").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
