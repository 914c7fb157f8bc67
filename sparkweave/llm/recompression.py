"""Substring deduplication by recompression.

Rounds of recompression rename token runs and adjacent pairs. A name is the hash of what it stands for, so equal
strings get equal names on every executor without a dictionary, and a round needs no shuffle. Each symbol knows the
range of words that its existence depends on. So a symbol whose range lies inside a window appears in every copy
of this window, at the same place: it is an interior symbol.

1. For every window of ``window`` words one interior symbol of the last round is its anchor (windows without one are their own
   anchor). Neighbouring windows that share an anchor are one row: anchor, context, document, first and last window; the
   context is a digest of all words of these windows.
2. Anchors that occur once belong to no repeated window. Occurrences of the others with equal context repeat each other
   window by window: all but the first are removed.
3. Where an anchor has several contexts, the first occurrence of each gives its windows one by one, named by digests of
   their words; all but the first of equal windows are removed.
4. The words of removed windows leave their documents.

No pairs are formed and no group is gathered: occurrences meet through sums and minima that are combined before
each shuffle. Names of symbols only bring occurrences together, so a collision of names costs a comparison and no
words. What is removed is equal by a 128-bit cryptographic digest (BLAKE2) of the words themselves, which verifies the repeat
without moving the texts to each other.

Cases: null, empty and blank texts have no words and stay as they are (zero words, the hash of the empty string); documents shorter
than the window lose nothing; repeated rows and equal ``doc_id``: rows with one ``doc_id`` are numbered by
their text, and the smaller text counts as earlier; equal rows are one document that comes back once for each row; rows with a null ``doc_id``
come after all others; an empty table gives no rows; other columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import dropped, in_arrow, table, written

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of text that are parsed at once.
BLOCK = 1 << 21
#: Symbols of so many words are preferred.
ENOUGH = 4


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


_breaks = np.zeros(256, bool)
_breaks[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of some texts, one after the other: ``text`` has one space after each, word i begins at ``begin[i]``."""

    def __init__(self, texts: list[bytes]) -> None:
        codes = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        gap = _breaks[codes]
        last = gap & np.r_[False, ~gap[:-1]]  # the break after a word
        flat = codes.copy()
        flat[last] = 0x20
        self.text = flat[~gap | last].tobytes()
        edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: How many words each text has.
        self.sizes = np.diff(np.searchsorted(np.flatnonzero(last), edge))
        self.begin = np.r_[0, np.flatnonzero(np.frombuffer(self.text, np.uint8) == 0x20) + 1]

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words; each different word is hashed once."""
        offsets = pa.py_buffer(self.begin.astype(np.int64))
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin) - 1, [None, offsets, pa.py_buffer(self.text)]).dictionary_encode()
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in cells.dictionary.to_pylist()], np.uint64)
        return known[cells.indices.to_numpy()] if len(known) else known

    def digests(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """128-bit digests of the words from ``low`` to before ``high``, as two columns."""
        text, blake = self.text, hashlib.blake2b
        ranges = zip(self.begin[low].tolist(), (self.begin[high] - 1).tolist())
        return np.frombuffer(b"".join([blake(text[a:b], digest_size=16).digest() for a, b in ranges]), "<u8").reshape(-1, 2)


def names(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Names of the word sequences from ``low`` to before ``high``, from the names of two runs of 2**k words that cover each."""
    size = high - low
    out = np.zeros(len(low), np.uint64)
    run, width = hashes, 1
    while len(size) and width <= size.max():
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        out[at] = mix(run[low[at]] * MIX[1] + mix(run[high[at] - width] + size[at].astype(np.uint64) * MIX[0]))
        run = mix(run[: max(0, len(run) - width)] * MIX[1] + mix(run[width:] + MIX[2]))
        width *= 2
    return out


def rounds(hashes: np.ndarray, doc: np.ndarray, levels: int):
    """Names of each level: symbol, first word, end, first and end of the words that it depends on, document.

    Level 1 names maximal runs of one word; every further level names pairs of a left and a right symbol, the side
    being a bit of the symbol's hash in this round. A document's border counts as a word outside it, on which
    nothing inside a window may depend.
    """
    n = len(hashes)
    starts = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    name = mix(hashes[starts] + (ends - starts).astype(np.uint64) * MIX[0])
    own = doc[starts]
    lo, hi = starts - 1, ends + 1  # that a run is maximal depends on the words beside it
    yield name, starts, ends, lo, hi, own
    for level in range(levels):
        if len(name) < 2:
            return
        left = (mix(name + np.uint64((level + 1) * int(MIX[0]) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        with_next = np.zeros(len(name), bool)
        with_next[:-1] = left[:-1] & ~left[1:] & (own[:-1] == own[1:])
        second = np.r_[False, with_next[:-1]]
        alone = ~with_next & ~second
        # A symbol that stays alone depends on the neighbour that it could have been paired with.
        after_hi = np.r_[np.where(own[1:] == own[:-1], hi[1:], ends[:-1] + 1), ends[-1] + 1]
        after_lo = np.r_[np.where(own[1:] == own[:-1], lo[1:], lo[:-1]), lo[-1]]
        before_lo = np.r_[starts[0] - 1, np.where(own[1:] == own[:-1], lo[:-1], starts[1:] - 1)]
        before_hi = np.r_[hi[0], np.where(own[1:] == own[:-1], hi[:-1], hi[1:])]
        new_lo = np.where(alone & ~left, np.minimum(lo, before_lo), np.where(alone, np.minimum(lo, after_lo), lo))
        new_hi = np.where(alone & left, np.maximum(hi, after_hi), np.where(alone, np.maximum(hi, before_hi), hi))
        at = np.flatnonzero(with_next)
        name, ends = name.copy(), ends.copy()
        name[at] = mix(name[at] * MIX[1] + mix(name[at + 1] + MIX[2]))
        ends[at] = ends[at + 1]
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        keep = ~second
        name, starts, ends, lo, hi, own = name[keep], starts[keep], ends[keep], new_lo[keep], new_hi[keep], own[keep]
        yield name, starts, ends, lo, hi, own


def anchors(words: Words, window: int, levels: int):
    """Rows (anchor, context, document, first window, last window): document is an index, windows are word numbers in it."""
    hashes, sizes = words.hashes(), words.sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.r_[0, np.cumsum(sizes)][:-1]
    n = len(hashes)
    whole = np.arange(n) + window <= (offset + sizes)[doc] if n else np.zeros(0, bool)
    start = np.flatnonzero(whole)
    if not len(start):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64), empty, empty, empty
    *_, (symbol, first, end, lo, hi, _) = rounds(hashes, doc, levels)
    inside = np.flatnonzero((hi - lo <= window) & (lo >= 0) & (hi <= n))
    symbol, size, lo, hi = symbol[inside], (end - first)[inside], lo[inside], hi[inside]
    # Long enough symbols come first, then the least name, then the first place: a choice that neighbouring windows mostly share.
    score = np.minimum(size, ENOUGH) << 60 | (mix(symbol) >> np.uint64(36)).astype(np.int64) << 32 | n - np.arange(len(symbol))
    best = np.zeros(n, np.int64)
    for back in range(window):
        at = lo - back
        ok = np.flatnonzero((at >= hi - window) & (at >= 0))
        np.maximum.at(best, at[ok], score[ok])
    mine = best[start]
    chosen = np.where(mine > 0, n - (mine & (1 << 32) - 1), 0)
    # Windows without an interior symbol are their own anchor. Others reach at least half of the free words
    # to the left or to the right of their symbol's range; the anchor is the range with those words.
    a = np.where(mine > 0, lo[chosen], start) if len(lo) else start
    b = np.where(mine > 0, hi[chosen], start + window) if len(lo) else start + window
    half = (window - (b - a) + 1) // 2
    to_left = start <= a - half
    a, b = np.where(to_left, a - half, a), np.where(to_left, b, b + half)
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (start[1:] != start[:-1] + 1)])
    low, high, a, b = start[cut], start[np.r_[cut[1:], len(start)] - 1], a[cut], b[cut]
    own = doc[low]
    context = words.digests(low, high + window).copy()
    # The anchor's place in its first window is part of the context: equal contexts then hold equal windows in step.
    context[:, 0] ^= mix((a - low).astype(np.uint64) * MIX[0])
    name = names(hashes, a, b)
    return name, context, own, low - offset[own], high - offset[own]


def _blocks(batches):
    """Rows of the batches, their texts as bytes, joined up to BLOCK bytes."""
    rows: list = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            text = (row[1] or "").encode()
            rows.append((row[0], text, *row[2:]))
            size += len(text)
            if size >= BLOCK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def occurrence_rows(docs: DataFrame, window: int, levels: int) -> DataFrame:
    """anchor, c0, c1 (the context), doc, low, high for every document, where doc is its order key."""

    def run(batches):
        for rows in _blocks(batches):
            name, context, own, low, high = anchors(Words([r[1] for r in rows]), window, levels)
            keys = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(own))
            columns = [_signed(name), _signed(context[:, 0]), _signed(context[:, 1]), keys, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "c0", "c1", "doc", "low", "high"])

    return docs.transform(in_arrow, run, "anchor long, c0 long, c1 long, doc long, low int, high int")


def window_rows(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2 (a digest of the words), doc, start for the windows in the ranges of each document: columns doc, text, ranges."""

    def run(batches):
        for rows in _blocks(batches):
            words = Words([r[1] for r in rows])
            offset = np.cumsum(words.sizes) - words.sizes
            low = np.concatenate([[r["low"] + o for r in row[2]] for row, o in zip(rows, offset)])
            many = np.concatenate([[r["high"] - r["low"] + 1 for r in row[2]] for row in rows])
            start = np.unique(np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum()))
            own = np.searchsorted(offset, start, side="right") - 1
            digest = words.digests(start, start + window)
            keys = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([_signed(digest[:, 0]), _signed(digest[:, 1]), keys, pa.array((start - offset[own]).astype(np.int32))], names=["h1", "h2", "doc", "start"])

    return docs.transform(in_arrow, run, "h1 long, h2 long, doc long, start int")


def kept(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Columns doc, text, ranges (null: nothing to remove) to doc, n_words, n_removed, kept_sha256 and, on request, the kept text."""

    def run(batches):
        for rows in _blocks(batches):
            out: list[list] = [[], [], [], [], []]
            for key, text, ranges in rows:
                words, removed = text.split(), 0
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["low"] for r in ranges], 1)
                    np.add.at(edge, [r["high"] + window for r in ranges], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    rest = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    rest = words
                data = b" ".join(rest)
                for column, value in zip(out, (key, len(words), removed, hashlib.sha256(data).hexdigest(), data.decode() if with_text else None)):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.transform(in_arrow, run, "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _repeated(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (anchor, c0, c1, doc, low, high) those whose anchor occurs more than once, and the table of these anchors.

    The anchors are a table of their own, so the join reads two exchanges and a common anchor's rows can be split.
    """
    shared = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    return found.join(shared, "anchor"), shared


def repeated_ranges(docs: DataFrame, window: int = 20, levels: int = 2) -> DataFrame:
    """doc and ranges: array of (low, high), the windows of the document that also start earlier. ``docs``: doc, text; doc is unique."""
    spark = docs.sparkSession
    repeated, shared = _repeated(occurrence_rows(docs, window, levels))
    rows = written(repeated, "repeated")
    dropped(shared)
    first = written(rows.groupBy("anchor", "c0", "c1").agg(F.min(F.struct("doc", "low", "high")).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    again = rows.join(first.where("n > 1").select("anchor", "c0", "c1", "first"), ["anchor", "c0", "c1"])
    again = written(again.where("doc <> first.doc or low <> first.low").select("doc", "low", "high"), "again")
    mixed = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    high = first.join(mixed, "anchor").select("first.*")
    ranges = written(high.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")
    windows = written(window_rows(docs.join(ranges, "doc").select("doc", "text", "ranges"), window), "windows")
    equal = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = windows.join(equal, ["h1", "h2"]).where(F.struct("doc", "start") != F.col("first")).select("doc", F.col("start").alias("low"), F.col("start").alias("high"))
    out = written(again.unionByName(late).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "removed")
    dropped(rows, first, again, ranges, windows)
    return out


def deduplicate(docs: DataFrame, window: int = 20, levels: int = 2, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    ids = None
    if odd:
        docs, ids = _numbered(docs)
    else:
        docs = docs.withColumnRenamed("doc_id", "doc")
    ranges = repeated_ranges(docs, window, levels)
    out = kept(docs.join(ranges, "doc", "left").select("doc", "text", "ranges"), window, with_text)
    if ids is not None:
        out = out.join(ids, "doc").withColumn("doc_id", F.explode(F.array_repeat("doc_id", F.col("times").cast("int")))).drop("times")
        return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    return out.withColumnRenamed("doc", "doc_id")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows under unique numbers in order of doc_id (nulls last), then text; and doc, doc_id, times."""
    distinct = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    ordered = written(distinct.sort(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()).withColumn("doc", F.monotonically_increasing_id()), "numbered")
    return ordered.select("doc", "text"), ordered.select("doc", "doc_id", "times")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
