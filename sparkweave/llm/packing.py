"""Best-fit packing with Martello-Toth dominance reduction.

Each document becomes one or more pieces of at most ``capacity`` tokens. Pieces are packed into as few
sequences as the method finds. The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries whatever the size of the corpus: item sets that provably dominate every alternative
are fixed first (Martello and Toth's reduction procedure), and best-fit decreasing packs the rest, both in
bulk on counts. Pieces then take the planned places by their rank among the pieces of equal length.

Cases: a null or empty text is one piece that holds the end token only; a repeated row is packed as often as
it occurs; rows with equal ``doc_id`` (also null) are separate documents; an empty table gives no rows; other
columns are ignored, whatever their names; very long texts are cut, never truncated.
"""

from __future__ import annotations

import bisect
import base64
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.llm.common import dropped, in_arrow, table, written

#: The fast encoder is used for texts of these characters only; for them it was tested to give equal ids.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\u00a0-\u024f\u2010-\u2027\u20ac]")
_encoders: dict = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(tokenizer: str, ranks: str | None):
    """texts -> list of id lists. ``ranks``: the same vocabulary for tiktoken, which encodes plain texts faster.

    Texts with special-token strings or with characters outside the tested range go to the tokenizer itself.
    """
    if (tokenizer, ranks) not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer)
        specials = [t.content for t in slow.get_added_tokens_decoder().values()]
        fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        odd = re.compile("|".join([_PLAIN.pattern, *map(re.escape, specials)]))

        def encode(texts: list[str]) -> list[list[int]]:
            out: list = [None] * len(texts)
            rest = []
            for i, text in enumerate(texts):
                if fast is not None and not odd.search(text):
                    out[i] = fast.encode_ordinary(text)
                else:
                    rest.append(i)
            for i in rest:
                out[i] = slow.encode(texts[i], add_special_tokens=False).ids
            return out

        _encoders[(tokenizer, ranks)] = encode
    return _encoders[(tokenizer, ranks)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the task that made it and its rank there among equal lengths; ids on request.

    The first piece of a document longer than ``capacity`` takes what is left over by full pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long" + ", ids array<int>" * with_ids

    def run(batches):
        encode = encoder(tokenizer, ranks)
        seen = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            keys = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for low in range(0, len(texts), 64):
                for key, ids in zip(keys[low : low + 64], encode([t or "" for t in texts[low : low + 64]])):
                    ids.append(end_id)
                    data = np.asarray(ids, dtype="<u4")
                    cut = len(ids) % capacity or capacity
                    bounds = [0, *range(min(cut, len(ids)), len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        row = (key, piece, a, b - a, zlib.crc32(data[a:b].tobytes()), part, seen[b - a], data[a:b].astype("i4") if with_ids else None)
                        seen[b - a] += 1
                        for column, value in zip(columns, row):
                            column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, schema)


@dataclass
class Plan:
    """Sequences in groups: a group has ``count`` sequences that hold the same lengths in the same order."""

    capacity: int
    groups: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)  # ((length, how many), ...), count

    @property
    def sequences(self) -> int:
        return sum(count for _, count in self.groups)

    def runs(self) -> dict[int, np.ndarray]:
        """For each length the rows (first rank, first sequence, pieces a sequence, offset of the first), by rank."""
        out, base = defaultdict(list), 0
        used: dict[int, int] = defaultdict(int)
        for pattern, count in self.groups:
            offset = 0
            for length, many in pattern:
                out[length].append((used[length], base, many, offset))
                used[length] += many * count
                offset += many * length
            base += count
        return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _add(groups: dict, pattern: list[int], count: int) -> None:
    merged: list[list[int]] = []
    for length in sorted(pattern, reverse=True):
        if merged and merged[-1][0] == length:
            merged[-1][1] += 1
        else:
            merged.append([length, 1])
    groups[tuple(map(tuple, merged))] += count


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[dict, dict[int, int]]:
    """Fix the sets that dominate all feasible sets with their largest item; return them and what is left.

    For an item of length w, with k the number of smallest items that fit beside it together:
    k = 0: alone. One other fits at most, or the largest that fits fills the rest exactly: with that one. At most
    two fit: with the largest one if no pair is longer; with the best pair if its longer item is the largest that
    fits and no two items above the shorter one fit together.
    """
    left = {w: n for w, n in counts.items() if n}
    fixed: dict = defaultdict(int)
    sizes = sorted(left)

    def take(pattern: list[int], times: int) -> None:
        _add(fixed, pattern, times)
        for w in pattern:
            left[w] -= times
            if not left[w]:
                del left[w]
                sizes.pop(bisect.bisect_left(sizes, w))

    def fits(w: int, room: int) -> list[int]:
        """Up to three of the smallest items beside one of length w that fit together."""
        out = []
        for s in sizes:
            for _ in range(min(3 - len(out), left[s] - (s == w))):
                if s > room:
                    return out
                out.append(s)
                room -= s
            if len(out) == 3:
                break
        return out

    def largest(room: int, w: int) -> int | None:
        i = bisect.bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] - (sizes[i] == w) < 1:
            i -= 1
        return sizes[i] if i >= 0 else None

    def best_pair(room: int, w: int) -> tuple[int, int] | None:
        """The two items with the largest sum that fit; of equal sums the one with the longest item."""
        free = [(s, left[s] - (s == w)) for s in sizes if s <= room and left[s] > (s == w)]
        i, j, best = 0, len(free) - 1, None
        while i <= j:
            (b, _), (a, many) = free[i], free[j]
            if a + b > room:
                j -= 1
            else:
                if (a > b or many > 1) and (best is None or a + b > sum(best)):
                    best = (a, b)
                i += 1
        return best

    changed = True
    while changed:
        changed = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                room = capacity - w
                small = fits(w, room)
                top = largest(room, w)
                if not small:
                    take([w], left[w])
                elif len(small) == 1 or w + top == capacity:
                    take([w, top], left[w] // 2 if top == w else min(left[w], left[top]))
                elif len(small) == 2:
                    pair = best_pair(room, w)
                    if pair is None or top >= sum(pair):
                        take([w, top], left[w] // 2 if top == w else min(left[w], left[top]))
                    elif pair[0] == top and 2 * _next_above(sizes, pair[1]) > room:
                        take([w, *pair], 1 if len({w, *pair}) < 3 else min(left[w], left[pair[0]], left[pair[1]]))
                    else:
                        break
                else:
                    break
                changed = True
    return fixed, left


def _next_above(sizes: list[int], low: int) -> int:
    """The shortest item longer than ``low``; two of at least that length fit only if twice it does."""
    i = bisect.bisect_right(sizes, low)
    return sizes[i] if i < len(sizes) else 1 << 40


def best_fit(left: dict[int, int], capacity: int) -> dict:
    """Best-fit decreasing on counts: the tightest sequences are filled first, all equal ones together."""
    open_: dict[int, list] = defaultdict(list)  # room -> [[pattern, count], ...]
    rooms: list[int] = []
    done: dict = defaultdict(int)

    def put(pattern: list[int], count: int, room: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
        open_[room].append([pattern, count])

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            i = bisect.bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, pattern, count = capacity, [], 1 << 62
            each = room // w
            full = min(count, n // each)
            if full:
                put(pattern + [w] * each, full, room - each * w)
                n -= full * each
                count -= full
            if count and n:
                put(pattern + [w] * n, 1, room - n * w)
                count, n = count - 1, 0
            if count and pattern:
                put(pattern, count, room)
    for groups in open_.values():
        for pattern, count in groups:
            _add(done, pattern, count)
    return done


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Dominating sets first, then best fit for the remainder."""
    fixed, left = reduce_by_dominance(counts, capacity)
    for pattern, count in best_fit(left, capacity).items():
        fixed[pattern] += count
    return Plan(capacity, sorted(fixed.items(), reverse=True))


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Tokens are made once and kept as a table of pieces. The histogram that comes to the driver has at most ``capacity`` rows.
    """
    spark = docs.sparkSession
    pieces = written(tokenized_pieces(docs, tokenizer, ranks, capacity, end_id, with_ids), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(counts, capacity).runs())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(bases, ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("base").to_numpy(zero_copy_only=False) + batch.column("part_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for w in np.unique(length):
                rows = np.flatnonzero(length == w)
                table_ = runs.value[int(w)]
                run = table_[np.searchsorted(table_[:, 0], rank[rows], side="right") - 1]
                at = rank[rows] - run[:, 0]
                sequence[rows] = run[:, 1] + at // run[:, 2]
                offset[rows] = run[:, 3] + at % run[:, 2] * w
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return placed.select(*names, "part_rank", "base").transform(in_arrow, place, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken"))
