"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed choice of token positions; the tokens at the other positions are ignored. Hashes of all masked windows of
benchmark items and documents are joined, so a hit tolerates substitutions at ignored positions. The default masks
leave a hit in every stretch of 13 tokens with at most two substitutions (the test tries all cases). Every hit fixes an
alignment of the item with the document; around it all aligned tokens are compared, and a document counts as contaminated if
some stretch of ``stretch`` aligned tokens (the whole item, if shorter) agrees in at least ``share`` of them.

``contaminations`` also finds what those masks can miss. Items of 10 to 12 tokens have masks of their own length, which leave a hit for any
two substitutions; shorter items are found if they stand in a document as a whole. Tokens beyond a document's ends count
as substitutions there. Documents are searched only for the lengths that the benchmark has.

Tokens are the parts of the lower-cased text between ASCII space, punctuation and control characters; characters of
scripts without spaces between words are tokens of their own.

The benchmark's hashes are broadcast only if they are fewer than ``BROADCAST_ROWS``; else the join shuffles, and so does the join
that brings hits and texts together. Only DataFrame functions are used.

Cases: null and empty texts have no tokens and are never contaminated; items with fewer tokens than the span of a mask
are not searched by ``overlaps`` and must agree in all tokens in ``contaminations``; items without tokens are never found; rows with one doc_id (or item_id) count as alternatives, of which the
best counts; null ids come back as null ids if contaminated; empty tables give no rows; other columns are ignored; long texts
are searched whole.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import table, written

#: Positions of the tokens that count, for windows of SPAN tokens.
MASKS = ((0, 1, 2, 5, 7, 9), (0, 1, 4, 7, 8, 9), (0, 2, 4, 5, 8, 9))
SPAN = 10
STRETCH, SHARE = 13, 0.8
BROADCAST_ROWS = 1_000_000
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of scripts that put no spaces between words.
_ALONE = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def token_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's tokens."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.rlike(text, F.lit(_ALONE)), F.regexp_replace(text, _ALONE, " $1 ")).otherwise(text)
    tokens = F.split(F.lower(text), _SPLIT)
    return F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.xxhash64(t))


def _agreeing(n: int, share: float) -> int:
    return n if n < SPAN else math.ceil(n * share)


def masks_for(n: int, share: float = SHARE) -> tuple[tuple[int, ...], ...]:
    """Masks for whole items of n tokens: all tokens below SPAN; else one for each choice of as many of five parts as tokens may differ."""
    if n < SPAN:
        return (tuple(range(n)),)
    away = n - _agreeing(n, share)
    return tuple(tuple(p for p in range(n) if p % 5 not in gone) for gone in combinations(range(5), away))


def windows(rows: DataFrame, keys: list[str], tokens: str, masks=MASKS, span: int | None = None) -> DataFrame:
    """keys, seed, pos: the masked hash of every window of the column ``tokens``, with its place. ``span``: of whole items; it enters the hash."""
    mark = [] if span is None else [F.lit(span)]
    span = span or 1 + max(p for m in masks for p in m)
    starts = F.when(F.size(tokens) >= span, F.sequence(F.lit(0), F.size(tokens) - span)).otherwise(F.array().cast("array<int>"))
    t = F.col(tokens)

    def masked(n: int, mask: tuple[int, ...]) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*mark, F.lit(n), *(t[i + p] for p in mask)))

    seeds = [masked(n, mask) for n, mask in enumerate(masks)]
    zipped = F.arrays_zip(*(s.alias(f"s{n}") for n, s in enumerate(seeds)))
    each = rows.select(*keys, F.posexplode(zipped).alias("pos", "s"))
    return each.select(*keys, "pos", F.explode(F.array(*(F.col("s").getField(f"s{n}") for n in range(len(seeds))))).alias("seed"))


def document_key() -> Column:
    """Tells the documents (doc_id, text) apart, also those with one id or none."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, stretch: int = STRETCH, share: float = SHARE, whole: bool = False) -> DataFrame:
    """doc_id, item_id, matched, best, start, n_tokens for every contaminated pair.

    matched: agreeing tokens on the best alignment; best: agreeing tokens in its best stretch; start: the document's token
    that is aligned with the item's first (it can be negative); n_tokens: the item's tokens. ``whole``: items shorter than ``stretch`` are searched with masks of their length, and windows may reach beyond a document.
    """
    judged = _judged(docs, items, masks, stretch, share, whole)
    top = F.max(F.struct("matched", "best", (-F.col("start")).alias("early"), "n_tokens")).alias("t")
    out = judged.groupBy("doc_id", "item_id").agg(top)
    return out.select("doc_id", "item_id", F.col("t.matched").cast("long").alias("matched"), F.col("t.best").cast("long").alias("best"), (-F.col("t.early")).cast("long").alias("start"), F.col("t.n_tokens").cast("long").alias("n_tokens"))


def _judged(docs: DataFrame, items: DataFrame, masks, stretch: int, share: float, whole: bool) -> DataFrame:
    """dk, doc_id, item_id, matched, best, start, n_tokens for every alignment that makes a document contaminated."""
    item_key = F.xxhash64("item_id", "text")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("dk", document_key())
    items = items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("ik", item_key)
    span = 1 if whole else 1 + max(p for m in masks for p in m)
    tested = written(items.select("ik", "item_id", token_hashes(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") >= span).dropDuplicates(["ik"]), "items")
    searches = [(masks, None)]
    if whole:
        lengths = [r["n"] for r in tested.where(F.size("item_tokens") < stretch).select(F.size("item_tokens").alias("n")).distinct().collect()]
        searches += [(masks_for(n, share), n) for n in sorted(lengths)]

    def of_items(masks, n) -> DataFrame:
        rows = tested if n is None else tested.where(F.size("item_tokens") == n)
        return windows(rows, ["ik"], "item_tokens", masks, n)

    def of_docs(masks, n) -> DataFrame:
        # At the ends as many tokens are added as may differ.
        more = 0 if not whole else (stretch if n is None else n) - _agreeing(stretch if n is None else n, share)
        tokens = F.concat(F.array_repeat(F.lit(0).cast("long"), more), token_hashes(F.col("text")), F.array_repeat(F.lit(0).cast("long"), more))
        found = windows(docs.select("dk", tokens.alias("doc_tokens")), ["dk"], "doc_tokens", masks, n)
        return found.withColumn("pos", F.col("pos") - more)

    seeds = reduce(DataFrame.unionByName, (of_items(*s) for s in searches)).join(tested.select("ik", F.size("item_tokens").alias("n")), "ik").select("seed", "ik", "n", F.col("pos").alias("item_pos")).distinct()
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    found = reduce(DataFrame.unionByName, (of_docs(*s) for s in searches))
    # Few documents have hits. As a table their size is known, so Spark can broadcast them while they are small and need not move all texts.
    # A document's hits are one row, bounded by its own length, so that its text is split once and only aligned tokens go on.
    hits = found.join(seeds, "seed").select("dk", "ik", "n", (F.col("pos") - F.col("item_pos")).alias("start")).distinct()
    hits = written(hits.groupBy("dk").agg(F.collect_list(F.struct("ik", "start", "n")).alias("hits")), "hits")

    def facing(tokens: Column) -> Column:
        """For each hit the document's tokens that face the item's, null beyond the document."""
        return F.transform("hits", lambda h: F.struct(h["ik"].alias("ik"), h["start"].alias("start"), F.transform(F.sequence(F.lit(0), h["n"] - 1), lambda j: F.get(tokens, h["start"] + j)).alias("a")))

    # The array of one array is a variable of the transformation, so tokens are computed once for all hits.
    each = F.explode(F.flatten(F.transform(F.array(token_hashes(F.col("text"))), facing)))
    aligned = docs.join(hits, "dk").select("dk", "doc_id", each.alias("h")).select("dk", "doc_id", "h.*").join(tested, "ik")
    flags = F.transform(F.zip_with("a", "item_tokens", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same.cast("int"))
    aligned = aligned.select("dk", "doc_id", "item_id", "start", F.size("item_tokens").alias("n_tokens"), flags.alias("flags"))
    long = F.least(F.lit(stretch), F.col("n_tokens"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n_tokens") - long), lambda i: F.aggregate(F.slice("flags", i + 1, long), F.lit(0), lambda s, x: s + x)))
    return aligned.withColumns({"best": best, "matched": F.aggregate("flags", F.lit(0), lambda s, x: s + x), "least": F.when(F.col("n_tokens") < (SPAN if whole else 0), F.col("n_tokens")).otherwise(F.ceil(long * share))}).where("best >= least")


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``overlaps`` for items of all lengths, also at the ends of documents."""
    return overlaps(docs, items, whole=True)


def contaminated_keys(docs: DataFrame, items: DataFrame) -> DataFrame:
    """dk: the ``document_key`` of every contaminated document."""
    return _judged(docs, items, MASKS, STRETCH, SHARE, True).select("dk").distinct()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
