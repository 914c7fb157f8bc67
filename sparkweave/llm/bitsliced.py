"""Exact top-k by inner product with a bit-sliced index.

Rows go into blocks. In a block every quantised attribute is held as slices: bitmap b of attribute d has a
bit for each row whose value has bit b (values count from the block's least; the lowest bits are left out of
the index). A query's scores are made by bitmap arithmetic: the slices that the query's components select are
added by carry-save adders into the slices of the sum. From the most significant slice downward the k best rows are
narrowed down; the bits left out bound each sum's error, and all rows that this bound leaves open
are resolved exactly. Blocks are independent; their best rows are merged.

Blocks are packed where their rows lie, after the rows were dealt out evenly, in the narrowest whole numbers that hold them. Vectors whose
components are too large for sums of 64 bits stand beside the index and are scored with whole numbers of any size.

A task streams the blocks of a slice of the index past some groups of queries and keeps the best rows of each query, whose least
score then bounds what later blocks are searched for. So it holds one block at a time and its queries' results, and what is shuffled
is k rows for each query and slice; neither a block nor a query is.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; rows
with a repeated id all take part, but none is a candidate for a query of this id, and queries of one id have one list of results;
shorter vectors count as filled up with zeros, also beside a very long one; ties go to the smaller id; fewer rows than k: all of them; scores beyond 64
bits count as the last number of that side; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.llm.common import dropped, in_arrow, table, written

#: Most rows of a block of the index, queries of a group where they are few, and most components of a block (half as many where they are wide).
BLOCK_ROWS, BLOCK_QUERIES, AREA = 65536, 256, 1 << 22
#: Most queries of a group, most components of one, most blocks of a slice, and the pairs of groups and slices that are aimed at.
GROUP_QUERIES, GROUP_AREA, SLICE_BLOCKS, PAIRS = 4096, 1 << 20, 16, 256
#: Components that are whole numbers of any size at once.
EXACT_AREA = 1 << 16
#: Lowest bits of the values that the index leaves out.
LEFT_OUT = 1


def _add(bitmaps: np.ndarray, columns: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Bitmaps of weights 2**w, as places among ``bitmaps``, to one bitmap for each weight of their sum."""
    weights = max(columns, default=-1) + 1
    most, n = 0, 0
    for w in range(weights):
        n = len(columns.get(w, ())) + n // 2
        most = max(most, n)
    now, after, half = (np.empty((m, bitmaps.shape[1]), bitmaps.dtype) for m in (most + 1, most + 1, most // 3 + 1))
    out, w, carries = [], 0, 0
    while w < weights or carries:
        at, n, carries = columns.get(w, ()), carries, 0
        if len(at):
            np.take(bitmaps, at, axis=0, out=now[n : n + len(at)], mode="clip")
            n += len(at)
        some = n > 0
        while n > 1:
            third = n // 3
            if third:
                a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                h, carry = half[:third], after[carries : carries + third]
                np.bitwise_xor(a, b, out=h)
                np.bitwise_and(a, b, out=carry)
                np.bitwise_and(c, h, out=b)
                np.bitwise_or(carry, b, out=carry)
                np.bitwise_xor(h, c, out=a)
                now[third : n - 2 * third] = now[3 * third : n]
                carries, n = carries + third, n - 2 * third
            else:
                np.bitwise_and(now[0], now[1], out=after[carries])
                np.bitwise_xor(now[0], now[1], out=now[0])
                carries, n = carries + 1, 1
        out.append(now[0].copy() if some else None)
        now, after, w = after, now, w + 1
    return out


class Block:
    """The index of some rows: values, ids and slices."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, left_out: int = LEFT_OUT) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values, self.left_out = ids[order], values[order], left_out
        n, dims = values.shape
        self.low = self.values.min(axis=0).astype(np.int64) if n else np.zeros(dims, np.int64)
        above = self.values.max(axis=0).astype(np.int64) - self.low if n else self.low
        self.bits = max(int(above.max(initial=0)).bit_length(), left_out + 1)
        self.words = -(-n // 64)
        self.all = self._pack(np.ones((1, n), bool))[0]
        #: Of each attribute the slices from bit left_out upward, and after those of all attributes their complements.
        self.depth = self.bits - left_out
        self.bitmaps = np.empty((2, dims, self.depth, self.words), "<u8")
        for d in range(0, dims, step := max(1, (1 << 18) // max(1, n))):
            above = np.ascontiguousarray(self.values[:, d : d + step].T).astype(np.int64) - self.low[d : d + step, None]
            for b in range(self.depth):
                self.bitmaps[0, d : d + step, b] = self._pack((above >> (b + left_out)) & 1)
        np.bitwise_and(~self.bitmaps[0], self.all, out=self.bitmaps[1])
        self.bitmaps = self.bitmaps.reshape(2 * dims * self.depth, self.words)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 8), np.uint8)
        packed = np.packbits(bits.astype(bool), axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view("<u8")

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        at = np.flatnonzero(np.unpackbits(bitmap[words].view(np.uint8), bitorder="little"))
        return words[at >> 6] * 64 + (at & 63)

    def top(self, query: np.ndarray, k: int, own: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own; those below ``least`` may be missing."""
        size, dims = np.abs(query), len(query)
        begin = (np.arange(dims) + np.where(query < 0, dims, 0)) * self.depth
        parts: dict[int, list[np.ndarray]] = {}
        for bit in range(int(size.max(initial=0)).bit_length()):
            at = begin[(size >> bit & 1).astype(bool)]
            for b in range(self.depth if len(at) else 0):
                parts.setdefault(bit + b, []).append(at + b)
        sums = _add(self.bitmaps, {w: np.concatenate(x) for w, x in parts.items()})
        # A row's exact score exceeds its sum by less than `slack` in units of the lowest slice.
        slack = -(-int(size.sum()) * ((1 << self.left_out) - 1) // (1 << self.left_out))
        usable = self.all.copy()
        for at in range(*np.searchsorted(self.ids, [own, own + 1])):
            usable[at // 64] &= ~np.uint64(1 << (at % 64))
        if least is not None:
            # The score is `base`, 2**left_out times the sum, and what the bits left out add (at most `most`) or take away.
            less = int(size[query < 0].sum())
            base = int(query @ self.low) - (((1 << self.depth) - 1) << self.left_out) * less
            most = (int(size.sum()) - less) * ((1 << self.left_out) - 1)
            usable &= self._at_least(sums, -((base + most - least) >> self.left_out))
        if int(np.bitwise_count(usable).sum()) > 4 * k:
            # Downward from the highest slice: sure rows, rows still level with the boundary, and the boundary's value.
            sure, level, value = np.zeros_like(usable), usable, 0
            for s in reversed(sums):
                value *= 2
                if s is None:
                    continue
                upper = level & s
                if int(np.bitwise_count(sure | upper).sum()) >= k:
                    level, value = upper, value + 1
                else:
                    sure |= upper
                    level = level & ~s
            usable = usable & self._at_least(sums, value - slack)
        rows = self._rows(usable)
        scores = self.values[rows].astype(np.int64) @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    def _at_least(self, sums: list, least: int) -> np.ndarray:
        """The rows whose sum is ``least`` or more."""
        if least <= 0:
            return self.all
        above, level = np.zeros_like(self.all), self.all
        for w in reversed(range(max(len(sums), least.bit_length()))):
            s = sums[w] if w < len(sums) and sums[w] is not None else np.zeros_like(self.all)
            if least >> w & 1:
                level = level & s
            else:
                above = above | (level & s)
                level = level & ~s
        return above | level


class Best:
    """The k best rows of each query of a group, of all that it met."""

    def __init__(self, keys: np.ndarray, k: int) -> None:
        self.keys, self.k = keys, k
        self.n, self.ids, self.scores = np.zeros(len(keys), np.int64), np.zeros((len(keys), k), np.int64), np.zeros((len(keys), k), np.int64)

    def least(self, at: int) -> int | None:
        """The score below which no row counts any more."""
        return int(self.scores[at, -1]) if self.k and self.n[at] == self.k else None

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            n = self.n[at]
            ids, scores = np.r_[self.ids[at, :n], ids], np.r_[self.scores[at, :n], scores]
            best = np.lexsort((ids, ~scores))[: self.k]  # ~: the order of -x without its overflow
            self.n[at] = n = len(best)
            self.ids[at, :n], self.scores[at, :n] = ids[best], scores[best]

    def batch(self) -> pa.RecordBatch:
        filled = np.arange(self.k) < self.n[:, None]
        columns = np.repeat(self.keys, self.n), self.ids[filled], self.scores[filled]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, key: str, vector: str, *extra: str) -> DataFrame:
    """id, x and ``extra``: the vectors whose components are all finite numbers."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & F.col(key).isNotNull()).where(finite).select(F.col(key).cast("long").alias("id"), x.alias("x"), *extra)


def _limit(dims: int) -> int:
    """Components below it have inner products below 2**62."""
    return 1 << min(30, (62 - max(1, dims).bit_length()) // 2)


def _packed(rows: DataFrame, parts: int, most: int, area: int, scale: int) -> DataFrame:
    """block, part, wide, ids, dims, v: the rows in ``parts`` even blocks, as binary columns of whole numbers (wide: of the unscaled numbers)."""
    names, types = ["block", "part", "wide", "ids", "dims", "v"], [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.binary()]

    def binary(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], "<i4")), pa.py_buffer(x)])

    def pack(batches):
        block, part = TaskContext.get().partitionId(), 0
        #: Of vectors that are wide or not, with lengths of as many bits (so that filling up at most doubles them): ids, vectors.
        waiting: dict[tuple[bool, int], list] = {}

        def full(wide: bool, group: list) -> pa.RecordBatch:
            nonlocal part
            dims = max(len(v) for _, v in group)
            values = np.zeros((len(group), dims), "<f8" if wide else "<i4")
            for n, (_, v) in enumerate(group):
                values[n, : len(v)] = v
            if not wide:
                low, high = values.min(initial=0), values.max(initial=0)
                values = values.astype(next(t for t in ("<i1", "<i2", "<i4") if np.iinfo(t).min <= low and high <= np.iinfo(t).max), copy=False)
            part += 1
            row = [block], [part], [wide], binary(np.array([key for key, _ in group], "<i8")), [dims], binary(values)
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.floor(flat.astype("<f8") * scale)
            small = np.where(np.abs(whole) < _limit(0), whole, 0).astype("<i4")
            end = 0
            for key, n in zip(batch.column("id").to_pylist(), batch.column("x").value_lengths().to_pylist()):
                begin, end = end, end + n
                wide = bool(n and np.abs(whole[begin:end]).max() >= _limit(n))
                group = waiting.setdefault((wide, n.bit_length()), [])
                longest = max(n, len(group[0][1]) if group else 0)
                if group and (len(group) >= most or (len(group) + 1) * longest * (1 + wide) > area):
                    yield full(wide, group)
                    group.clear()
                # The longest vector stands first, so that the size of the matrix is known.
                group.append((key, (flat if wide else small)[begin:end]))
                if len(group[0][1]) < n:
                    group[0], group[-1] = group[-1], group[0]
        for (wide, _), group in waiting.items():
            if group:
                yield full(wide, group)

    return rows.repartition(parts).transform(in_arrow, pack, "block int, part int, wide boolean, ids binary, dims int, v binary")


def _whole(values: np.ndarray, wide: bool, scale: int) -> np.ndarray:
    """The components as whole numbers of any size."""
    if not wide:
        return values.astype(object)
    flat = [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in values.ravel().tolist()]
    out = np.empty(values.size, object)
    out[:] = flat
    return out.reshape(values.shape)


def _exact_top(ids: np.ndarray, values: np.ndarray, query: list, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows but the query's own, from whole numbers of any size."""
    last = (1 << 63) - 1
    scores = np.array([min(max(sum(a * b for a, b in zip(row, query)), -last - 1), last) for row in values.tolist()], np.int64)
    good = np.flatnonzero(ids != own)
    best = good[np.lexsort((ids[good], ~scores[good]))[:k]]  # ~: the order of -x without its overflow
    return ids[best], scores[best]


def _matrix(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    keys, dims = np.frombuffer(row[side + "ids"], "<i8"), row[side + "dims"]
    width = len(row[side + "v"]) // max(1, len(keys) * dims) or 1
    return keys, np.frombuffer(row[side + "v"], "<f8" if row[side + "wide"] else f"<i{width}").reshape(len(keys), dims)


def _as_long_as(vector: np.ndarray, dims: int) -> np.ndarray:
    return np.r_[vector[:dims], np.zeros(max(0, dims - len(vector)), vector.dtype)]


def _found(index: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, score: the best rows of each query in each slice of the index."""

    def search(batches):
        best: dict[tuple[int, int], Best] = {}
        at, block = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                asked_ids, asked = _matrix(row, "q_")
                group = row["q_block"], row["q_part"]
                if group not in best:
                    best[group] = Best(asked_ids, k)
                one = best[group]
                if row["wide"] or row["q_wide"]:
                    ids, values = _matrix(row)
                    step, q_step = (max(1, EXACT_AREA // max(1, row[x])) for x in ("dims", "q_dims"))
                    for r in range(0, len(ids), step):
                        some = _whole(values[r : r + step], row["wide"], scale)
                        for q in range(0, len(asked), q_step):
                            for i, query in enumerate(_whole(asked[q : q + q_step], row["q_wide"], scale).tolist(), q):
                                one.add(i, *_exact_top(ids[r : r + step], some, query, k, int(asked_ids[i])))
                    continue
                if at != (row["block"], row["part"]):
                    at, block = (row["block"], row["part"]), Block(*_matrix(row))
                for i, own in enumerate(asked_ids.tolist()):
                    one.add(i, *block.top(_as_long_as(asked[i].astype(np.int64), row["dims"]), k, own, one.least(i)))
        for one in best.values():
            yield one.batch()

    asked = queries.select(*(F.col(c).alias("q_" + c) for c in ("block", "part", "wide", "ids", "dims", "v")))
    # A nested loop without code generation: it makes a row for a pair when it is read, and shuffles neither side.
    return index.hint("shuffle_replicate_nl").crossJoin(asked).transform(in_arrow, search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on the column id. Every query meets every block of the index."""
    rows = usable(vectors, key, vector)
    if vectors.select(vector).schema[0].dataType.simpleString() == "array<float>":
        rows = rows.withColumn("x", F.col("x").cast("array<float>"))
    rows = written(rows, "usable")
    asked = F.coalesce(is_query, F.lit(False))
    length = F.size("x").cast("long")
    n, area, n_asked, asked_area = (x or 0 for x in rows.agg(F.count("*"), F.sum(length), F.count_if(asked), F.sum(F.when(asked, length))).first())
    # A sixteenth more than it takes: rows are not dealt out quite evenly, and a few rows too many would make a block of their own.
    blocks = max(4, -(-17 * n // (16 * BLOCK_ROWS)), -(-17 * area // (16 * AREA))) if n else 1
    groups = max(1, min(-(-n_asked // BLOCK_QUERIES), PAIRS // 4), -(-17 * n_asked // (16 * GROUP_QUERIES)), -(-17 * asked_area // (16 * GROUP_AREA)))
    slices = max(-(-blocks // SLICE_BLOCKS), min(blocks, PAIRS // groups))
    index = written(_packed(rows, blocks, BLOCK_ROWS, AREA, scale), "index")
    queries = written(_packed(rows.where(asked), groups, GROUP_QUERIES, GROUP_AREA, scale), "queries")
    dropped(rows)
    found = _found(index.coalesce(slices), queries, k, scale)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
