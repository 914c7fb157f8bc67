"""Hard negatives by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label. For each positive the negatives wanted are the nearest rows of other
labels whose scores lie in a window below the positive's score. The windows of one anchor overlap, so they are not searched one by one: the
positives' upper limits, in descending order, split the scores into disjoint slots, and every row falls into at most one. Each
block of rows keeps the ``k`` best rows of each slot (the combiner), blocks are merged slot by slot, and merges from the lowest slot upward give for
each slot the ``k`` best rows at or below its limit, which answer all windows; what lies below a window's lower limit goes.

All anchors meet all rows, in blocks: rows were dealt out evenly and packed as matrices. Scores are exact: products of doubles while
sums stay below 2**53, of 64-bit integers below 2**62, else of whole numbers of any size.

Cases: rows with a null label, id or vector, or with a null or non-finite component take no part; shorter vectors count as filled up with zeros;
rows with a repeated id all take part, each as an anchor of its own, but none is a positive or negative of an anchor of this id; ties go to the smaller id;
fewer positives or negatives than asked for: all of them; without a positive an anchor has no rows; negative and zero scores of positives have the
windows that the inequalities give, mostly none; scores beyond 64 bits count as the last number of that side; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.llm.bitsliced import AREA, _limit, _whole, usable
from sparkweave.llm.common import free_names, in_arrow, table, written

#: Most rows of a block, most anchors that meet a block at once.
BLOCK_ROWS, BLOCK_ANCHORS = 32768, 256
LAST = (1 << 63) - 1


def _packed(rows: DataFrame, parts: int, most: int, scale: int, extra: list[str]) -> DataFrame:
    """block, part, wide, ids, dims, v and ``extra`` (numbers) of the rows (id, x, extra) in ``parts`` even blocks, as binary columns; wide: unscaled doubles."""
    names = ["block", "part", "wide", "dims", "v", "ids", *extra]

    def pack(batches):
        block, part = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("id", *extra)}
            begins = np.r_[0, np.cumsum(lengths)]
            with np.errstate(over="ignore"):
                whole = np.floor(flat * scale)
            wide = np.array([bool(n and np.abs(whole[b : b + n]).max() >= _limit(int(n))) for b, n in zip(begins, lengths)], bool)
            for flag in (False, True):
                # Long vectors last, so that few short ones are filled up.
                at = np.flatnonzero(wide == flag)
                at = at[np.argsort(lengths[at], kind="stable")]
                while len(at):
                    n = 1
                    while n < min(len(at), most) and (n + 1) * max(1, lengths[at[n]]) <= AREA:
                        n += 1
                    some, at = at[:n], at[n:]
                    values = np.zeros((n, lengths[some].max()), "<f8" if flag else "<i4")
                    for i, k in enumerate(some):
                        values[i, : lengths[k]] = (flat if flag else whole)[begins[k] : begins[k] + lengths[k]]
                    row = [block, part, flag, values.shape[1], values.tobytes(), *(c[some].tobytes() for c in numbers.values())]
                    types = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * (2 + len(extra))]
                    part += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    schema = "block int, part int, wide boolean, dims int, v binary, ids binary" + "".join(f", {c} binary" for c in extra)
    return rows.repartition(parts).transform(in_arrow, pack, schema)


def _numbers(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], "<i8")


def _values(row: dict, side: str = "") -> np.ndarray:
    return np.frombuffer(row[side + "v"], "<f8" if row[side + "wide"] else "<i4").reshape(len(row[side + "ids"]) // 8, row[side + "dims"])


def scores(row: dict, scale: int) -> np.ndarray:
    """The inner products of all anchors with all rows of a block."""
    left, right = _values(row, "a_"), _values(row)
    dims = min(left.shape[1], right.shape[1])
    left, right = left[:, :dims], right[:, :dims]
    if row["wide"] or row["a_wide"]:
        left, right = _whole(left, row["a_wide"], scale).tolist(), _whole(right, row["wide"], scale).tolist()
        return np.array([[min(max(sum(a * b for a, b in zip(x, y)), -LAST - 1), LAST) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    largest = int(np.abs(left.astype(np.int64)).max(initial=0)) * int(np.abs(right.astype(np.int64)).max(initial=0)) * max(1, dims)
    kind = np.float64 if largest < 1 << 53 else np.int64
    return (left.astype(kind) @ right.T.astype(kind)).astype(np.int64)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, in order; ties by id."""
    if len(score) > 8 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], ~score[some]))[:k]]
    return np.lexsort((ids, ~score))[:k]  # ~: the order of -x without its overflow


def _meeting(rows: DataFrame, anchors: DataFrame, blocks: int, extra: list[str]) -> DataFrame:
    """The rows of both kinds of blocks; every block of anchors meets every block of rows."""
    asked = anchors.select(*(F.col(c).alias("a_" + c) for c in ("wide", "dims", "v", "ids", *extra)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return rows.join(asked, "block")


def mined(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 3, positives: int = 5, low: int = 50, high: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchor is the number of the anchor's row.

    ``is_anchor``: a condition on the column id; ``label``: an integer expression on the columns of ``vectors``. Windows: low * p <= 100 * n <= high * p.
    """
    (mark,) = free_names(vectors.columns, "__label")
    named = vectors.withColumn(mark, label.cast("long")).where(F.col(mark).isNotNull())
    rows = written(usable(named, key, vector, mark).withColumnRenamed(mark, "label"), "usable")
    n = rows.count()
    blocks = max(4, -(-n // BLOCK_ROWS)) if n else 1
    asked = written(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "asked")
    groups = max(1, -(-asked.count() // BLOCK_ANCHORS))
    index = written(_packed(rows, blocks, BLOCK_ROWS, scale, ["label"]), "index")
    anchors = written(_packed(asked, groups, BLOCK_ANCHORS, scale, ["label", "anchor"]), "anchors")

    def near(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, found, out = _numbers(row, "ids"), _numbers(row, "label"), scores(row, scale), [[], [], [], []]
                for own, mark, anchor, score in zip(_numbers(row, "a_ids"), _numbers(row, "a_label"), _numbers(row, "a_anchor"), found):
                    good = np.flatnonzero((labels == mark) & (ids != own))
                    top = good[best(ids[good], score[good], positives)]
                    for column, values in zip(out, (np.full(len(top), anchor), np.full(len(top), own), ids[top], score[top])):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["anchor", "anchor_id", "positive_id", "positive_score"])

    first = _meeting(index, anchors, blocks, ["label", "anchor"]).transform(in_arrow, near, "anchor long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    exact = F.col("positive_score").cast("decimal(20,0)")
    limits = [F.ceil(exact * low / 100).cast("long").alias("least"), F.floor(exact * high / 100).cast("long").alias("limit")]
    first = written(first.select("anchor", "anchor_id", "place", "positive_id", "positive_score", *limits), "positives")

    # Anchors with their limits, in descending order, go into blocks again.
    listed = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "limit"))), lambda p: p["limit"]).alias("limits"), F.min("least").alias("least"))
    full = F.concat("limits", F.array_repeat(F.lit(None).cast("long"), positives))
    lows = [F.coalesce(F.get(full, F.lit(i)), F.lit(-LAST - 1)).alias(f"u{i}") for i in range(positives)]
    names = ["label", "anchor", "least", *(f"u{i}" for i in range(positives))]
    again = written(_packed(asked.join(listed.select("anchor", "least", *lows), "anchor"), groups, BLOCK_ANCHORS, scale, names), "anchors")

    def slots(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, found, out = _numbers(row, "ids"), _numbers(row, "label"), scores(row, scale), [[], [], [], []]
                uppers = np.stack([_numbers(row, f"a_u{i}") for i in range(positives)], axis=1)
                for own, mark, anchor, least, upper, score in zip(_numbers(row, "a_ids"), _numbers(row, "a_label"), _numbers(row, "a_anchor"), _numbers(row, "a_least"), uppers, found):
                    good = np.flatnonzero((labels != mark) & (ids != own) & (score <= upper[0]) & (score >= least))
                    # The slot is the last limit that is not below the score; a missing one is the lowest number, so no row but one of that score reaches it.
                    slot = np.searchsorted(upper[::-1], score[good], side="left")
                    slot = positives - 1 - slot
                    for i in range(positives):
                        mine = good[slot == i]
                        top = mine[best(ids[mine], score[mine], k)]
                        for column, values in zip(out, (np.full(len(top), anchor), np.full(len(top), i + 1), ids[top], score[top])):
                            column.append(values)
                columns = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "slot", "negative_id", "negative_score"])

    held = _meeting(index, again, blocks, names).transform(in_arrow, slots, "anchor long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    held = held.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    # From the lowest slot upward: a slot's best rows, then those of the slots below it, k of them.
    merged = F.array_sort(F.collect_list(F.struct((-F.col("slot")).alias("down"), "rn", "negative_id", "negative_score")))
    suffixes = held.groupBy("anchor").agg(merged.alias("held"))

    def merge(state: Column, slot: Column) -> Column:
        mine = F.filter("held", lambda x: x["down"] == -slot)
        top = F.slice(F.concat(F.transform(mine, lambda x: F.struct(x["negative_id"].alias("id"), x["negative_score"].alias("score"))), F.get(state, F.size(state) - 1)), 1, k)
        return F.concat(state, F.array(top))

    start = F.array(F.array()).cast("array<array<struct<id:bigint,score:bigint>>>")
    # After the last slot the array holds: nothing, the slots from the last one, ..., the slots from the first one.
    suffixes = suffixes.select("anchor", F.aggregate(F.sequence(F.lit(positives), F.lit(1), F.lit(-1)), start, merge).alias("from"))
    answers = first.join(suffixes, "anchor").withColumn("window", F.filter(F.element_at("from", positives - F.col("place") + 2), lambda x: x["score"] >= F.col("least")))
    out = answers.select("anchor", "anchor_id", "positive_id", "positive_score", F.posexplode("window").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"), "anchor")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label).drop("anchor")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
