"""Items of all lengths against brute force that judges without masks."""

import itertools
import math
import random
import re

from sparkweave.llm import decontamination as D


def tokens(text):
    text = re.sub(r"([぀-ヿ一-鿿])", r" \1 ", text or "")
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if t]


def brute(docs, items):
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = tokens(text), tokens(item)
        for start in range(-len(b), len(a)) if b else ():
            flags = [0 <= start + j < len(a) and a[start + j] == b[j] for j in range(len(b))]
            long = min(13, len(b))
            best = max(sum(flags[k : k + long]) for k in range(len(b) - long + 1))
            if best >= (long if len(b) < 10 else math.ceil(long * 0.8)):
                key = (sum(flags), best, -start)
                out[(d, i)] = max(out.get((d, i), key), key)
    return {(*k, m, b, -e) for k, (m, b, e) in out.items()}


def test_items_of_all_lengths(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 4, 9, 10, 11, 12, 13, 20)] + [(50, "これは短い問題です何ですか"), (51, "日本語"), (52, "?!")]
    docs = [(0, "前の文これは短い問題です何ですか後の文"), (1, "Das ist 日本語 hier"), (2, None), (3, "")]
    for n, item in items[1:8]:
        for gone in [(), *((i,) for i in range(min(n, 13))), *itertools.combinations(range(min(n, 13)), 2)]:
            ws = ["sub" if i in gone else w for i, w in enumerate(item.split())]
            before, after = rng.choice([0, 3]), rng.choice([0, 3])
            # Also with the changed tokens at an end missing.
            ws = ws[1:] if 0 in gone and not before else ws
            docs.append((len(docs), " ".join([*(word() for _ in range(before)), *ws, *(word() for _ in range(after))])))
    got = {tuple(r)[:5] for r in D.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and len({i for _, i, *_ in want}) >= 8


def test_many_hits_in_one_long_document(spark):
    """A document with thousands of hits is split once, and repeated items and rows count as one."""
    import time

    item = " ".join(f"t{i}" for i in range(30))
    long = " ".join(f"{item} x{i}" for i in range(4000))
    docs = spark.createDataFrame([(1, long, 0), (2, "t1 t2 t3 other words", 1), (None, item, 2), (3, None, 3), (3, "", 4)], "doc_id long, text string, hits int")
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, item, 2), (9, None, 3)], "item_id long, text string, n int")
    began = time.time()
    got = sorted((r["doc_id"] or 0, r["item_id"], r["matched"], r["start"]) for r in D.contaminations(docs, items).collect())
    assert got == [(0, 7, 30, 0), (0, 8, 30, 0), (1, 7, 30, 0), (1, 8, 30, 0)]
    assert time.time() - began < 60
